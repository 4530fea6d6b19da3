"""Ingestion of many files: one scan per file type, bad files as error rows, pages put together."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from rowmill.functions.text import is_json
from rowmill.sources import files, readers
from rowmill.sources.folders import path_exists

_READERS = {
    "csv": readers.read_csv,
    "json": readers.read_json,
    "jsonl": readers.read_json_lines,
    "xml": readers.read_xml,
    "parquet": readers.read_parquet,
    "avro": readers.read_avro,
    "yaml": readers.read_yaml,
    "yml": readers.read_yaml,
    "xlsx": readers.read_excel,
    "xls": readers.read_excel,
    "txt": readers.read_text,
}


_SPARK_ERRORS = (PySparkException, Py4JJavaError)
#: Kinds that are another name of a kind, as an extension.
_ALIASES = {"xlsx": ("xlsx", "xlsm")}
#: A Parquet file without rows holds a footer only: a longer one that gives no row is not looked into.
EMPTY_BYTES = 1 << 20


@dataclass
class Ingested:
    frames: dict[str, DataFrame]   # one DataFrame per file type
    errors: DataFrame              # (source, error)


def _error_rows(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "source string, error string")


def _json(spark: SparkSession, paths: list[str], names: str):
    """Files that are no JSON are left out and become error rows; a job over whole texts finds them."""
    texts = readers.reader_of(spark, names).option("wholetext", True).text(paths)
    bad = texts.where(~is_json(F.col("value"))).select(F.col("_metadata.file_path").alias("source"), F.lit("Malformed JSON").alias("error"))
    return readers.read_json(spark, paths, mode="DROPMALFORMED", names=names), bad


def _json_lines(spark: SparkSession, paths: list[str], names: str):
    """Lines that are no JSON are left out; a file that has some becomes an error row with their number.

    Of a line with more behind its value Spark reads the value: the row stays, the line is counted."""
    lines = readers.reader_of(spark, names).text(paths)
    blank = F.length(F.trim("value")) == 0
    bad = lines.where(~blank & ~is_json(F.col("value"))).groupBy(F.col("_metadata.file_path").alias("source")).agg(
        F.concat(F.lit("Malformed lines: "), F.count(F.lit(1)).cast("string")).alias("error"))
    return readers.read_json_lines(spark, paths, mode="DROPMALFORMED", names=names), bad


def _parquet(spark: SparkSession, paths: list[str], names: str):
    """Files without a readable footer are left out and become error rows; broken pages of others still end a read.

    Spark reads all footers to merge the columns. Only where that fails, files that give no row are found by a
    job over the footers, files that are empty but whole are told apart by their marks, and the paths of the bad ones, which are
    error rows anyway, come to the driver.
    """
    try:
        return readers.read_parquet(spark, paths, names), None
    except _SPARK_ERRORS as problem:
        reason = str(problem).split("\n")[0]
    reader = lambda: readers.reader_of(spark, names)
    path = F.col("_metadata.file_path").alias("source")
    files_ = reader().format("binaryFile").load(paths)
    try:
        lenient = reader().options(mergeSchema=True, ignoreCorruptFiles=True).parquet(*paths)
        schema = lenient.schema
    except _SPARK_ERRORS:  # no file has a footer
        return None, files_.select(path, F.lit(reason).alias("error"))
    quiet = files_.select(path).join(lenient.select(path).distinct(), "source", "left_anti")
    marked = lambda part: F.hex(part) == F.lit("PAR1".encode().hex())
    whole = files_.where(F.col("length") <= EMPTY_BYTES).select(path, F.length("content").alias("n"), "content").where(
        marked(F.substring("content", 1, 4)) & marked(F.expr("substring(content, n - 3, 4)"))).select("source")
    bad = [row["source"] for row in quiet.join(whole, "source", "left_anti").collect()]
    good = reader().schema(schema).parquet(*paths)
    return good.where(~F.col("_metadata.file_path").isin(bad)), _error_rows(spark, [(p, "Not a Parquet file") for p in bad])


_CHECKED = {"json": _json, "jsonl": _json_lines, "parquet": _parquet}


def _read(spark: SparkSession, kind: str, paths: list[str], names: str = "*"):
    """(records or None, error rows or None) of the files of one kind; a kind that cannot be read at all is an error row per path."""
    try:
        frame, bad = _CHECKED[kind](spark, paths, names) if kind in _CHECKED else (_READERS[kind](spark, paths, names=names), None)
    except _SPARK_ERRORS as problem:
        return None, _error_rows(spark, [(path, str(problem).split("\n")[0]) for path in paths])
    return frame if frame is not None and frame.columns else None, bad


def _together(spark: SparkSession, found: dict, failed: list[DataFrame]) -> Ingested:
    errors = [*failed, *[bad for _, bad in found.values() if bad is not None]]
    frames = {kind: frame for kind, (frame, _) in found.items() if frame is not None}
    return Ingested(frames, reduce(DataFrame.unionByName, errors) if errors else _error_rows(spark, []))


def ingest_files(spark: SparkSession, sources: list[tuple[str, str]]) -> Ingested:
    """Read (path, type) pairs; paths of one type are read together. Unknown types, paths that do not exist and bad files become error rows."""
    by_type: dict[str, list[str]] = {}
    failed = []
    for path, kind in sources:
        if kind not in _READERS:
            failed.append((path, f"Unknown file type: {kind}"))
        elif not path_exists(spark, path):
            failed.append((path, f"No such file: {path}"))
        else:
            by_type.setdefault(kind, []).append(path)
    found = {kind: _read(spark, kind, paths) for kind, paths in by_type.items()}
    return _together(spark, found, [_error_rows(spark, failed)] if failed else [])


def ingest_directory(spark: SparkSession, directory: str, pattern: str = "*") -> Ingested:
    """All files of a folder whose names match, grouped by extension (a folder whose name matches is read too, for other patterns than ``*``).

    The driver learns which known extensions occur; Spark's readers list each one's files by a glob.
    """
    kind = files.type_by_extension()
    listing = files.list_files(spark, directory, pattern).select("path", kind.alias("kind"))
    known = listing.where(F.col("kind").isin(*_READERS)).select("kind").distinct().collect()  # at most one row per reader
    other = listing.where(~F.col("kind").isin(*_READERS)).select(
        F.col("path").alias("source"), F.concat(F.lit("Unknown file type: "), "kind").alias("error"))
    where = directory if pattern == "*" else f"{directory.rstrip('/')}/{pattern}"
    found = {row["kind"]: _read(spark, row["kind"], [where], _any_case(row["kind"])) for row in sorted(known)}
    return _together(spark, found, [other])


def _any_case(kind: str) -> str:
    """A glob for the extensions of a kind, in small and capital letters."""
    either = lambda name: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in name)
    return "*.{" + ",".join(either(name) for name in _ALIASES.get(kind, (kind,))) + "}"


def concat_pages(pages: DataFrame, page: str, body: str, item_schema: str, page_size: int = 100,
                 max_pages: int | None = None) -> DataFrame:
    """Items of paginated responses, (page, position, item): rows of landed JSON bodies, one per page.

    A page is a list, or an object with its list under one of PAGE_KEYS. Reading stops before an empty
    page or a body without a list, and after a short page, ``has_more: false`` or ``max_pages``.
    """
    listed = F.from_json(body, f"array<{item_schema}>")
    fields = ", ".join(f"{key} array<{item_schema}>" for key in readers.PAGE_KEYS) + ", has_more boolean"
    parsed = (
        (pages if max_pages is None else pages.where(F.col(page) <= max_pages))
        .withColumn("_o", F.when(~F.ltrim(F.col(body)).startswith("["), F.from_json(body, fields)))
        .withColumn("_items", F.coalesce(F.when(F.ltrim(F.col(body)).startswith("["), listed),
                                         *[F.col(f"_o.{key}") for key in readers.PAGE_KEYS]))
        .withColumn("_n", F.coalesce(F.size("_items"), F.lit(0)))
    )
    empty = F.col("_items").isNull() | (F.col("_n") == 0)
    last = empty | (F.col("_n") < page_size) | ~F.coalesce(F.col("_o.has_more"), F.lit(True))
    stop = parsed.agg(F.min(F.when(last, F.col(page))).alias("stop")).scalar()
    kept = parsed.where(~empty & (stop.isNull() | (F.col(page) <= stop)))
    return kept.select(page, F.posexplode("_items").alias("position", "item"))
