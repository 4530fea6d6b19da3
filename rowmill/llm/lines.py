"""Removal of lines that many documents share, decided on hashes and returned as run-length keep bitmaps.

DataFrame functions only.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window, functions as F

from rowmill.llm.staging import free_name, stage
from rowmill.session import shuffle_partitions

#: What is stripped from both ends of a line for its key.
BLANKS = " \t\n\x0b\x0c\r"
#: A hash is taken for frequent, and so handled by pre-aggregation, when this many of its lines are in the documents
#: of a 64th of all; the choice changes the plan only, not the result. At most FREQUENT hashes are broadcast.
SAMPLE, OFTEN, FREQUENT = 64, 16, 1024


def _ascii_lower(text: Column) -> Column:
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(df: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """One row per line that is long enough: id, of (a hash of the text), pos, and a 128-bit hash of the key in two parts."""
    text = F.col(text_col)
    lines = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("of"), F.posexplode(_lines(text)).alias("pos", "line"))
    keyed = lines.select("id", "of", "pos", _ascii_lower(F.btrim("line", F.lit(BLANKS))).alias("key"))
    return keyed.where(F.length("key") >= min_chars).select(
        "id", "of", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def keep_bitmaps(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20,
                 min_docs: int = 3) -> DataFrame:
    """id, of, dropped array<int> of each document that loses lines: the positions of the lines that go, in order.

    Hashes of keys are range-partitioned and sorted by document (the largest first) and position; a streaming window
    meets the first occurrence of a hash, which is the document that keeps its lines, and ranks the others. Hashes
    that are frequent in a sample are counted by pre-aggregation instead, because all rows of a hash share a
    partition; their verdicts, a bounded number, are broadcast. The rows of both ways together are all lines.

    Documents are counted by id: rows that repeat one, with the same text or others, count once, and all keep their
    lines if theirs is the largest id. A null id is smaller than others.
    """
    lines = stage(line_hashes(df, id_col, text_col, min_chars), "lines")
    sampled = lines.where(F.pmod(F.xxhash64("id", "of"), F.lit(SAMPLE)) == 0).groupBy("h1").agg(F.count(F.lit(1)).alias("n"))
    frequent = F.broadcast(sampled.where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "h1").limit(FREQUENT).select("h1"))

    few = lines.join(frequent, "h1", "left_anti")
    few = few.repartitionByRange(shuffle_partitions(df.sparkSession), "h1", "h2").sortWithinPartitions(
        "h1", "h2", F.desc("id"), "of", "pos")
    key = Window.partitionBy("h1", "h2")
    few = few.withColumns({"rank": F.dense_rank().over(key.orderBy(F.desc("id"))), "keeper": F.first("id").over(key.orderBy(F.desc("id")))})
    few = few.withColumn("docs", F.max("rank").over(key))

    many = lines.join(frequent, "h1", "left_semi")
    verdicts = many.groupBy("h1", "h2", "id").agg(F.count(F.lit(1))).groupBy("h1", "h2").agg(
        F.count(F.lit(1)).alias("docs"), F.max("id").alias("keeper"))
    many = many.join(F.broadcast(verdicts), ["h1", "h2"])

    columns = ["id", "of", "pos", "docs", "keeper"]
    gone = few.select(columns).unionByName(many.select(columns)).where(
        (F.col("docs") >= min_docs) & ~F.col("id").eqNullSafe(F.col("keeper")))
    return gone.groupBy("id", "of").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))


def keep_runs(dropped: Column, n_lines: Column) -> Column:
    """The keep bitmap of a document, run-length coded: start and length of each run of lines that stay."""
    starts = F.concat(F.array(F.lit(0)), F.transform(dropped, lambda d: d + 1))
    ends = F.concat(dropped, F.array(n_lines))
    runs = F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), (e - s).alias("length")))
    return F.filter(runs, lambda r: r["length"] > 0)


def drop_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", kept_col: str = "kept_text",
               min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """All rows and columns plus n_lines, n_dropped, keep_runs and the text of the lines that stay.

    A line's key is the line without blanks at both ends and with A-Z in lower case. Keys of at least ``min_chars``
    code points found in at least ``min_docs`` documents lose their lines except in the largest id holding them.
    Rows that repeat an id or a text are treated as ``keep_bitmaps`` tells. A null or empty text is one empty line, which stays; a document that loses all its lines gets the empty text.
    Added columns replace columns of the same name; all others pass unchanged.
    """
    bitmaps = keep_bitmaps(df, id_col, text_col, min_chars, min_docs)
    of, gone, its_id, its_of = (free_name(df, n) for n in ("_of", "_dropped", "_line_id", "_line_of"))
    bitmaps = bitmaps.select(F.col("id").alias(its_id), F.col("of").alias(its_of), F.col("dropped").alias(gone))
    joined = df.withColumn(of, F.xxhash64(text_col)).join(
        bitmaps, F.col(id_col).eqNullSafe(F.col(its_id)) & (F.col(of) == F.col(its_of)), "left")
    none = F.col(gone).isNull()
    lines = _lines(F.col(text_col))
    n_lines = F.size(lines)
    runs = F.when(none, F.array(F.struct(F.lit(0).alias("start"), n_lines.alias("length")))).otherwise(keep_runs(F.col(gone), n_lines))
    kept = F.array_join(F.flatten(F.transform(keep_runs(F.col(gone), n_lines), lambda r: F.slice(lines, r["start"] + 1, r["length"]))), "\n")
    added = {"n_lines": n_lines.cast("long"), "n_dropped": F.when(none, F.lit(0)).otherwise(F.size(gone)).cast("long"),
             "keep_runs": runs,
             kept_col: F.when(none, F.coalesce(F.col(text_col), F.lit(""))).otherwise(kept)}
    names = {c.lower() for c in added}
    rest = [F.col(f"`{c}`") for c in df.columns if c.lower() not in names]
    return joined.select(*rest, *[v.alias(k) for k, v in added.items()])
