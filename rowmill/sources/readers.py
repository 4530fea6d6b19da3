"""Readers: one lazy DataFrame per format; parsing runs on the executors."""

from __future__ import annotations

import csv
import io
import json
from typing import Iterable
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from rowmill.session import staged_path
from rowmill.operators.joins import lookup_join
from rowmill.operators.setops import union_by_name
from rowmill.sources import workbook

# Where a JSON or YAML document keeps its records, in order of preference.
JSON_KEYS = ("data", "records", "items", "results", "rows")
RAW_KEYS = ("data", "records", "items", "results")
PAGE_KEYS = ("data", "items", "results", "records")


def _paths(paths: str | Iterable[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def reader_of(spark: SparkSession, names: str):
    """A reader of the files whose name the glob ``names`` matches."""
    return spark.read if names == "*" else spark.read.option("pathGlobFilter", names)


def read_csv(spark: SparkSession, paths, delimiter: str = ",", encoding: str = "utf-8", has_header: bool = True, skip_rows: int = 0,
             quotechar: str = '"', multi_line: bool = False, one_header: bool = False, names: str = "*") -> DataFrame:
    """All values are text; without a header the columns are col_0, col_1, ...

    Each file's own header names its values: a job finds the first line of every file, and files whose headers differ are put
    together by name (a missing column is null, of a repeated name the last counts). ``one_header`` says that all files have the
    same and saves that job. ``skip_rows`` lines before the header are dropped in each file. Short rows give null,
    long rows lose the rest. ``multi_line`` allows line breaks in quoted cells (not in headers), but a file is then read by one task.
    """
    paths = _paths(paths)
    options = {"sep": delimiter, "quote": quotechar, "escape": quotechar}
    plain = reader_of(spark, names).options(encoding=encoding, multiLine=multi_line, mode="PERMISSIVE", **options)
    if skip_rows == 0 and not has_header:
        df = plain.csv(paths)
        return df.toDF(*[f"col_{i}" for i in range(len(df.columns))])
    if skip_rows == 0 and one_header:
        return plain.csv(paths, header=True)
    lines = _numbered_lines(reader_of(spark, names), paths, encoding)
    heads = _first_lines(lines, skip_rows)
    cells = lambda line: next(csv.reader([line], delimiter=delimiter, quotechar=quotechar))
    if not has_header:
        first = heads.select("head").first()
        columns = [] if first is None else [f"col_{i}" for i in range(len(cells(first[0])))]
        starts = heads.select("path", F.lit("").alias("head"), (F.col("at") - 1).alias("at"))
        return _by_header(lines, starts, {"": columns}, options)
    headers = {row[0]: cells(row[0]) for row in heads.select("head").distinct().collect()}  # one row per kind of header
    if len(headers) <= 1 and skip_rows == 0:
        return plain.csv(paths, header=True)
    if multi_line:
        grouped = heads.groupBy("head").agg(F.collect_list("path").alias("paths")).collect()
        return union_by_name([plain.csv([unquote(p) for p in row["paths"]], header=True) for row in sorted(grouped)])
    return _by_header(lines, heads, headers, options)


def _numbered_lines(reader, paths: list[str], encoding: str) -> DataFrame:
    """(value, path, start, at): lines with their file, the start of their block, and a number that grows within a file's block."""
    value = F.col("value") if encoding.lower().replace("-", "") == "utf8" else F.decode(F.col("value").cast("binary"), encoding)
    return reader.text(paths).select(
        value.alias("value"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"))


def _first_lines(lines: DataFrame, skipped: int) -> DataFrame:
    """(path, head, at): the line of every file after ``skipped`` ones (without any to skip: the first that is not blank)."""
    first = lines.where("start = 0") if skipped else lines.where("start = 0 and length(trim(value)) > 0")
    numbered = F.row_number().over(Window.partitionBy("path").orderBy("at"))  # Spark keeps the first rows of a file per task only
    found = first.withColumn("_nth", numbered).where(F.col("_nth") <= skipped + 1)
    return found.where(F.col("_nth") == skipped + 1).select("path", F.regexp_replace("value", "^\ufeff", "").alias("head"), "at")


def _by_header(lines: DataFrame, heads: DataFrame, headers: dict[str, list[str]], options: dict) -> DataFrame:
    """The lines behind each file's head as rows, their values named by the file's header: one scan for all headers."""
    names = list(dict.fromkeys(n for known in headers.values() for n in known))
    joined = lookup_join(lines, heads.withColumnRenamed("at", "_head_at"), "path", "inner")
    rows = joined.where("(start > 0 or at > _head_at) and length(trim(value)) > 0")
    parsed, place = [], {}
    for i, (head, known) in enumerate(headers.items()):
        if known:
            schema = ", ".join(f"c{k} STRING" for k in range(len(known)))
            parsed.append(F.from_csv(F.when(F.col("head") == head, F.col("value")), schema, options).alias(f"_{i}"))
            place.update({(i, name): k for k, name in enumerate(known)})  # of a repeated name the last counts
    rows = rows.select(*parsed)
    return rows.select(*[F.coalesce(*[F.col(f"_{i}.c{k}") for (i, n), k in place.items() if n == name]).alias(name) for name in names])


def read_json_lines(spark: SparkSession, paths, schema=None, mode: str = "PERMISSIVE", names: str = "*") -> DataFrame:
    """One record per line; blank lines are skipped. ``mode`` DROPMALFORMED leaves out lines that are no JSON."""
    reader = reader_of(spark, names).option("mode", mode)
    return (reader if schema is None else reader.schema(schema)).json(_paths(paths))


def unwrap(documents: DataFrame, keys: Iterable[str] = JSON_KEYS, bare: bool | None = None) -> DataFrame:
    """Records of documents: the first list among ``keys``, else the document itself.

    Every document is parsed once: its list, of whatever key, becomes one array with a slot per key, which is exploded. ``bare`` says
    whether documents without a list occur, whose own fields are columns then; None looks for one. A column that is text under
    one key and something else under another is text.
    """
    listed = [k for k in keys if k in documents.columns and isinstance(documents.schema[k].dataType, T.ArrayType)]
    if not listed:
        return documents
    own = [c for c in documents.columns if c not in listed]
    if bare is None:
        bare = bool(own) and not documents.where(F.coalesce(*[F.size(F.col(f"`{k}`")) for k in listed]).isNull()).isEmpty()
    slots = [(f"s{i}", documents.schema[k].dataType.elementType) for i, k in enumerate(listed)]
    if bare and own:
        slots.append(("own", T.StructType([documents.schema[c] for c in own])))
    empty = {slot: F.lit(None).cast(kind) for slot, kind in slots}
    filled = lambda slot, value: F.struct(*[(value if s == slot else c).alias(s) for s, c in empty.items()])
    placed = lambda slot: lambda item: filled(slot, item)
    arrays = [F.transform(F.col(f"`{k}`"), placed(slot)) for k, (slot, _) in zip(listed, slots)]
    if "own" in empty:
        arrays.append(F.array(filled("own", F.struct(*[F.col(f"`{c}`") for c in own]))))
    records = documents.select(F.explode(F.coalesce(*arrays)).alias("_r"))
    places: dict[str, list] = {}
    for slot, kind in slots:
        if isinstance(kind, T.StructType):
            for field in kind.fields:
                places.setdefault(field.name, []).append((F.col(f"_r.{slot}.`{field.name}`"), field.dataType))
        else:
            places.setdefault("_value", []).append((F.col(f"_r.{slot}"), kind))
    merged = lambda found: [c.cast("string") for c, _ in found] if len({k for _, k in found}) > 1 and any(
        isinstance(k, T.StringType) for _, k in found) else [c for c, _ in found]
    return records.select(*[F.coalesce(*merged(places[name])).alias(name) for name in sorted(places)])


def read_json(spark: SparkSession, paths, keys: Iterable[str] = JSON_KEYS, mode: str = "PERMISSIVE", names: str = "*",
              bare: bool | None = None) -> DataFrame:
    """Whole-file JSON: a list of records, or an object with the records under one of ``keys`` (RAW_KEYS: those of
    documents that name no format). ``mode`` DROPMALFORMED leaves out files that are no JSON; ``bare`` as in ``unwrap``."""
    return unwrap(reader_of(spark, names).options(multiLine=True, mode=mode).json(_paths(paths)), keys, bare)


def read_xml(spark: SparkSession, paths, row_tag: str = "record", schema=None, names: str = "*") -> DataFrame:
    """One row per ``row_tag`` element; attributes are ``@name``, own text is ``_text``.

    Values stay text. Of a repeated leaf tag the last one counts; repeated nested tags stay a list.
    """
    reader = reader_of(spark, names).options(rowTag=row_tag, attributePrefix="@", valueTag="_text", inferSchema=False)
    df = (reader if schema is None else reader.schema(schema)).xml(",".join(_paths(paths)))
    columns = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        leaf = isinstance(f.dataType, T.ArrayType) and not isinstance(f.dataType.elementType, T.StructType)
        columns.append((F.element_at(c, -1) if leaf else c).alias(f.name))
    return df.select(*columns)


def read_parquet(spark: SparkSession, paths, names: str = "*", same_columns: bool = False) -> DataFrame:
    """All columns that any file has; missing ones are null. ``same_columns`` says that all files have the same: one footer is read."""
    return reader_of(spark, names).option("mergeSchema", not same_columns).parquet(*_paths(paths))


def read_avro(spark: SparkSession, paths, names: str = "*") -> DataFrame:
    """Needs the spark-avro package on the class path."""
    return reader_of(spark, names).format("avro").load(_paths(paths))


def read_text(spark: SparkSession, paths, line_sep: str | None = None, names: str = "*") -> DataFrame:
    """One row per line; without ``line_sep`` a carriage return, a line feed or both end a line and are not kept."""
    reader = reader_of(spark, names)
    return (reader if line_sep is None else reader.option("lineSep", line_sep)).text(_paths(paths))


def _from_json_text(rows: DataFrame) -> DataFrame:
    """Rows of JSON text as typed columns: the text is landed once, then read with an inferred schema."""
    landed = staged_path(rows.sparkSession, "json")
    rows.write.text(landed)
    return rows.sparkSession.read.json(landed)


def read_yaml(spark: SparkSession, paths, encoding: str = "utf-8", names: str = "*") -> DataFrame:
    """A list of records, or a mapping with the records under one of RAW_KEYS; files are parsed side by side."""
    files = reader_of(spark, names).format("binaryFile").load(_paths(paths)).select("content")

    def parse(batches):
        import yaml

        for batch in batches:
            lines = []
            for content in batch["content"]:
                found = yaml.safe_load(content.decode(encoding))
                if isinstance(found, dict):
                    found = next((found[k] for k in RAW_KEYS if isinstance(found.get(k), list)), [found])
                for record in found if isinstance(found, list) else []:
                    record = record if isinstance(record, dict) else {"_value": record}
                    lines.append(json.dumps(record, default=str, ensure_ascii=False))
            yield pd.DataFrame({"value": lines}, dtype=object)

    return _from_json_text(files.mapInPandas(parse, "value string"))


def read_excel(spark: SparkSession, paths, sheet: int | str = 0, has_header: bool = True, skip_rows: int = 0,
               names: str = "*") -> DataFrame:
    """One sheet of every workbook, by position or name; a workbook is read by one task."""
    files = reader_of(spark, names).format("binaryFile").load(_paths(paths)).select("content")

    def parse(batches):
        for batch in batches:
            lines = []
            for content in batch["content"]:
                rows = workbook.sheet_rows(io.BytesIO(content), sheet)
                if not rows:
                    continue
                header = ([str(c) for c in rows[skip_rows]] if has_header
                          else [f"col_{i}" for i in range(len(rows[0]))])
                for row in rows[skip_rows + (1 if has_header else 0):]:
                    lines.append(json.dumps(dict(zip(header, row)), ensure_ascii=False))
            yield pd.DataFrame({"value": lines}, dtype=object)

    return _from_json_text(files.mapInPandas(parse, "value string"))


def excel_sheets(spark: SparkSession, paths) -> DataFrame:
    """(path, position, sheet) of every workbook."""
    files = spark.read.format("binaryFile").load(_paths(paths)).select("path", "content")

    def names(batches):
        for batch in batches:
            rows = [(path, i, name) for path, content in zip(batch["path"], batch["content"])
                    for i, name in enumerate(workbook.sheet_names(io.BytesIO(content)))]
            yield pd.DataFrame(rows, columns=["path", "position", "sheet"])

    return files.mapInPandas(names, "path string, position long, sheet string")
