"""Writers: one part file per partition; an empty input writes nothing."""

from __future__ import annotations

import io
import json

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from rowmill.sources import workbook


def write_csv(df: DataFrame, path: str, delimiter: str = ",", quotechar: str = '"', encoding: str = "utf-8") -> None:
    if df.isEmpty():
        return
    df.write.options(header=True, sep=delimiter, quote=quotechar, escape=quotechar, encoding=encoding,
                     ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", False).json(path)


def write_xml(df: DataFrame, path: str, row_tag: str = "record") -> None:
    """``@name`` columns become attributes, ``_text`` the element's text, lists repeated tags."""
    df.write.options(rootTag="root", rowTag=row_tag, attributePrefix="@", valueTag="_text").xml(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def write_avro(df: DataFrame, path: str, schema: str | None = None) -> None:
    """Needs the spark-avro package on the class path."""
    writer = df.write.format("avro")
    (writer if schema is None else writer.option("avroSchema", schema)).save(path)


def write_yaml(df: DataFrame, path: str) -> None:
    """Part files that each hold a YAML list; put together they are one list again."""
    def dump(batches):
        import yaml

        for batch in batches:
            records = [json.loads(text) for text in batch["value"]]
            if records:
                yield pd.DataFrame({"value": [yaml.safe_dump(records, allow_unicode=True, sort_keys=False).rstrip("\n")]})

    rows = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    rows.mapInPandas(dump, "value string").write.text(path)


def excel_files(df: DataFrame, rows_per_file: int = 1_000_000) -> DataFrame:
    """The records as workbooks, (file, content): at most ``rows_per_file`` rows each, as the format needs."""
    header = df.columns

    def pack(batches):
        from pyspark import TaskContext

        part, count, pending = TaskContext.get().partitionId(), 0, []

        def book(rows):
            target = io.BytesIO()
            workbook.write_rows(target, header, rows)
            return pd.DataFrame({"file": [f"part-{part:05d}-{count:03d}.xlsx"], "content": [target.getvalue()]})

        for batch in batches:
            pending += [list(json.loads(text).values()) for text in batch["value"]]
            while len(pending) >= rows_per_file:
                yield book(pending[:rows_per_file])
                pending, count = pending[rows_per_file:], count + 1
        if pending:
            yield book(pending)

    rows = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    return rows.mapInPandas(pack, "file string, content binary")


def write_excel(df: DataFrame, path: str, rows_per_file: int = 1_000_000) -> DataFrame:
    """Write the workbooks into the folder ``path``, which all executors must reach; returns (file, bytes)."""
    def save(batches):
        import os

        os.makedirs(path, exist_ok=True)
        for batch in batches:
            for name, content in zip(batch["file"], batch["content"]):
                with open(os.path.join(path, f".{name}.tmp"), "wb") as out:
                    out.write(content)
                os.replace(os.path.join(path, f".{name}.tmp"), os.path.join(path, name))
            yield pd.DataFrame({"file": batch["file"], "bytes": batch["content"].map(len)})

    written = excel_files(df, rows_per_file).mapInPandas(save, "file string, bytes long")
    rows = written.collect()  # one row per file
    return df.sparkSession.createDataFrame(rows, "file string, bytes long")
