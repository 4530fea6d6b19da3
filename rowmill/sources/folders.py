"""Folders of the shared storage, by Hadoop's file system of their path."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def folder_exists(spark: SparkSession, folder: str) -> bool:
    system, path = _at(spark, folder)
    return system.exists(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, or any path that matches it as a glob, exists."""
    system, at = _at(spark, path)
    return bool(system.exists(at)) or bool(system.globStatus(at))


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder and all it holds; a missing one is no error."""
    system, path = _at(spark, folder)
    system.delete(path, True)
