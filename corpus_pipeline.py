"""A corpus pipeline: quality, shared lines, near duplicates, mixture of sources, token ids.

Each stage gets the documents that its predecessor left and returns the columns of documents; the last returns
tokens. Documents with nulls or empty texts pass as the operators define it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowmill.llm import bpe, lines, minhash, mixing, quality
from rowmill.llm.queries import table
from rowmill.llm.staging import stage

#: How often the mixture repeats a small source at most; every document is used once at least.
MAX_REPEATS = 1.25


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose chance of the highest grade is below one half, by a model of the labelled documents."""
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.grade(docs, model).where("selected").select(docs.columns)


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three or more documents share stay in the document of the largest id only; n_chars follows the text."""
    done = lines.drop_lines(docs)
    text = {"text": F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("text")),
            "n_chars": F.when(F.col("n_dropped") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))}
    return done.select([text[c].alias(c) if c in text else F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest id; rows that repeat an id and a text
    are one document."""
    rows = minhash.near_duplicates(docs).where("id is not null").groupBy(F.col("id").alias("_gone"), F.col("of").alias("_of"))
    gone = stage(rows.agg(F.max("kept").alias("_kept"), F.min("kept").alias("_whole")).where("not _whole"), "gone")
    same = (F.col("doc_id") == F.col("_gone")) & (F.xxhash64("text") == F.col("_of"))
    left, repeated = docs.join(gone, same, "left_anti"), gone.where("_kept")
    if repeated.isEmpty():
        return left
    return left.union(docs.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are repeated up to the limit, in proportion to a power of their share of tokens."""
    return mixing.mix_sources(docs, max_repeats=MAX_REPEATS)[0].select(docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids and whether decoding the ids gives the text back."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.encode(docs.select("doc_id", "source", "text"), ranks, starts=None, checked="round_trip", keep_text=False)
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [("quality", quality_filter), ("line dedup", shared_lines), ("near dedup", near_duplicates),
          ("source mixture", mixture), ("byte bpe", token_ids)]

#: BPE and a fitted model are beyond SQL; tests/llm compares each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents; each result is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
