"""Merkle trees over the sections and paragraphs of documents. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from rowmill.session import shuffle_partitions

#: Leaves below a paragraph, cut by content: up to the first sentence sign or end of a word with 8 to 64 characters before it; or
#: what is left, or 64 characters without one.
LEAF = r"(?s).{8,64}?(?:[.!?。！？।؟、，…]+|[\x20\x09])[\x20\x09]*|.{1,64}"
#: Buckets per shuffle partition when documents are put next to their successors.
BUCKETS = 4


def tree(text: Column) -> Column:
    """struct root, sections[digest, paragraphs[digest, leaves]] of a text (null: the empty text).

    Sections are what empty lines divide, paragraphs are lines, leaves are short runs of a paragraph that its content
    cuts, so an insertion changes the leaves around it only. A leaf's digest is the MD5 of its text, a paragraph's the SHA-256 of its
    leaves' digests, a section's that of its paragraphs', the root's that of the sections'. Dividing can be undone, so
    roots are equal exactly if the texts are (but for collisions). ``leaves`` keeps half of each leaf's digest, with
    its length behind.
    """
    def paragraph(leaves):
        return F.struct(F.sha2(F.array_join(F.transform(leaves, lambda x: F.substring(x, 1, 32)), ""), 256).alias("digest"),
                        F.transform(leaves, lambda x: F.concat(F.substring(x, 1, 16), F.substring(x, 33, 9))).alias("leaves"))

    def section(paragraphs):
        return F.struct(_digest(paragraphs).alias("digest"), paragraphs.alias("paragraphs"))

    def leaves(p):
        return F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), lambda x: F.concat(F.md5(x), F.length(x).cast("string")))

    cut = F.split(F.coalesce(text, F.lit("")), "\n\n", -1)
    return F.transform(F.transform(cut, lambda s: F.transform(F.transform(F.split(s, "\n", -1), leaves), paragraph)), section)


def _digest(nodes: Column) -> Column:
    return F.sha2(F.array_join(F.transform(nodes, lambda x: x["digest"]), ""), 256)


def root(sections: Column) -> Column:
    """The fingerprint of a document."""
    return _digest(sections)


def marks(sections: Column) -> Column:
    """The distinct leaves of a tree."""
    return F.array_distinct(F.flatten(F.transform(sections, lambda s: F.flatten(F.transform(s["paragraphs"], lambda p: p["leaves"])))))


def _weight(leaves: Column) -> Column:
    return F.aggregate(leaves, F.lit(0).cast("long"), lambda n, x: n + F.substring(x, 17, 9).cast("long"))


def likeness(root_a: Column, marks_a: Column, root_b: Column, marks_b: Column) -> Column:
    """1 for equal roots, else the share of the trees' distinct leaves that both have, weighted by length (Dice); 0 if neither has any."""
    shared = F.try_divide(2.0 * _weight(F.array_intersect(marks_a, marks_b)), _weight(marks_a) + _weight(marks_b))
    return F.when(root_a == root_b, F.lit(1.0)).otherwise(F.coalesce(shared, F.lit(0.0)))


def differing(a: Column, b: Column) -> Column:
    """Section and paragraph numbers (from 0) whose digests differ; only sections that differ are entered."""
    def longest(x, y):
        return F.sequence(F.lit(0), F.greatest(F.coalesce(F.size(x), F.lit(1)), F.coalesce(F.size(y), F.lit(1)), F.lit(1)) - 1)

    def paragraphs(i):
        x, y = F.get(a, i)["paragraphs"], F.get(b, i)["paragraphs"]
        odd = F.filter(longest(x, y), lambda j: ~F.get(x, j)["digest"].eqNullSafe(F.get(y, j)["digest"]))
        return F.transform(odd, lambda j: F.struct(i.alias("section"), j.alias("paragraph")))

    odd = F.filter(longest(a, b), lambda i: ~F.get(a, i)["digest"].eqNullSafe(F.get(b, i)["digest"]))
    return F.flatten(F.transform(odd, paragraphs))


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text, sections and next_text, next_sections: each document beside the next by id (after the last: the first).

    Documents go into buckets of consecutive ids, whose bounds are quantiles of the ids (so many per shuffle
    partition, like the bounds of a range partitioning); the first document of a bucket is also put at the end of
    the bucket before it. So each text is shuffled once and no task holds more than its buckets. Rows with one id, also equal ones,
    come in the order of a hash of their texts; a null id comes first; a null text is empty; an only document follows
    itself.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    wanted = BUCKETS * shuffle_partitions(df.sparkSession)
    share = F.array(*[F.lit(i / wanted) for i in range(wanted)])
    found = docs.agg(F.percentile_approx("id", share, 32 * wanted).alias("bounds"),
                     F.count_if(F.col("id").isNull()).alias("nulls")).first()
    bounds = sorted(set(found["bounds"] or [0]))
    width = max(1, math.isqrt(len(bounds)))
    coarse = F.array(*[F.lit(x) for x in bounds[::width]])
    part = F.greatest(F.size(F.filter(coarse, lambda x: x <= F.col("id"))) - 1, F.lit(0))
    fine = F.slice(F.array(*[F.lit(x) for x in bounds]), part * width + 1, F.lit(width))
    docs = docs.withColumn("part", F.when(F.col("id").isNull(), 0).otherwise(part)).withColumn("fine", fine.alias("fine"))
    inside = F.greatest(F.size(F.filter("fine", lambda x: x <= F.col("id"))) - 1, F.lit(0))
    docs = docs.withColumn("bucket", F.when(F.col("id").isNull(), 0).otherwise(F.col("part") * width + inside))
    first = F.col("id").isNull() if found["nulls"] else F.col("id") == bounds[0]
    before = F.when(first, F.lit(len(bounds) - 1)).when(
        (F.col("bucket") > 0) & F.array_contains("fine", F.col("id")), F.col("bucket") - 1)
    places = F.when(before.isNull(), F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("again")))).otherwise(
        F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("again")), F.struct(before.alias("bucket"), F.lit(1).alias("again"))))
    placed = docs.select("id", "text", F.explode(places).alias("at")).select("id", "text", "at.bucket", "at.again")
    order = ["again", F.asc_nulls_first("id"), F.col("of")]
    near = placed.withColumn("of", F.xxhash64("text")).repartition("bucket").sortWithinPartitions("bucket", *order)
    near = near.withColumn("sections", tree(F.col("text")))
    w = Window.partitionBy("bucket").orderBy(*order)
    return near.withColumns({"next_text": F.lead("text").over(w), "next_sections": F.lead("sections").over(w)}).where(
        "again = 0").select("id", "text", "sections", "next_text", "next_sections")
