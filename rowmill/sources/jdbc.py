"""Databases through Spark's JDBC source and sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameReader, SparkSession


def reader(spark: SparkSession, url: str, query: str, properties: dict | None = None, partition_column: str | None = None,
           lower=None, upper=None, partitions: int | None = None) -> DataFrameReader:
    """A reader for a SELECT; with a partition column and bounds it is read by several tasks."""
    options = {"url": url, **(properties or {})}
    if partition_column is None:
        return spark.read.format("jdbc").options(query=query, **options)
    return spark.read.format("jdbc").options(
        dbtable=f"({query}) q", partitionColumn=partition_column, lowerBound=str(lower), upperBound=str(upper),
        numPartitions=str(partitions), **options)


def read_query(spark: SparkSession, url: str, query: str, **how) -> DataFrame:
    return reader(spark, url, query, **how).load()


def export_table(records: DataFrame, url: str, table: str, properties: dict | None = None) -> None:
    """Append the records, or the ``_source`` of envelope records, to a table; no records write nothing."""
    rows = records.select("_source.*") if "_source" in records.columns else records
    if rows.isEmpty():
        return
    rows.write.format("jdbc").options(url=url, dbtable=table, **(properties or {})).mode("append").save()
