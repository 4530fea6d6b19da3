"""Watching a folder over many polls: created, modified and deleted files, each reported once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowmill.session import shared_dir
from rowmill.sources.files import file_events, list_files
from rowmill.sources.folders import folder_exists, remove_folder

LISTING = "path string, length long, modificationTime timestamp"
EVENTS = "type string, path string, size long, timestamp timestamp"


class DirectoryWatch:
    """Compares every listing of a folder with the one before, across restarts.

    ``state`` keeps a listing and the events of every poll under its number. A poll counts once its commit is written,
    which comes last: one that ended before is made again under the same number and replaces what it left. A file source's
    stream reports new files only; this one sees changes of time and missing files too.
    """

    def __init__(self, spark: SparkSession, directory: str, state: str, pattern: str = "*"):
        self.spark, self.directory, self.pattern = spark, directory, pattern
        self.state = state.rstrip("/")

    def _of(self, kind: str, number: int) -> str:
        return f"{self.state}/{kind}/poll={number}"

    def last_poll(self) -> int:
        """Number of the last finished poll, 0 before the first."""
        commits = f"{self.state}/commits"
        if not folder_exists(self.spark, commits):
            return 0
        done = self.spark.read.schema("done boolean, poll long").parquet(commits)
        return done.agg(F.max("poll")).first()[0] or 0

    def poll(self, listing: DataFrame | None = None) -> DataFrame:
        """Events since the poll before: type, path, size, timestamp.

        ``listing`` (path, length, modificationTime) takes the place of the folder's own, e.g. an inventory of a store.
        """
        shared_dir(self.spark)
        number = self.last_poll() + 1
        found = list_files(self.spark, self.directory, self.pattern) if listing is None else listing
        kept = found.select("path", "length", "modificationTime")
        kept.write.mode("overwrite").parquet(self._of("listings", number))  # contents of files are not read
        read = lambda n: self.spark.read.schema(LISTING).parquet(self._of("listings", n))
        after = read(number)
        before = read(number - 1) if number > 1 else after.limit(0)
        file_events(before, after).write.mode("overwrite").parquet(self._of("events", number))
        self.spark.range(1).select(F.lit(True).alias("done")).write.mode("overwrite").parquet(self._of("commits", number))
        if number > 2:
            remove_folder(self.spark, self._of("listings", number - 2))
        return self.spark.read.schema(EVENTS).parquet(self._of("events", number))

    def events(self) -> DataFrame:
        """Events of all finished polls with the number of their ``poll``."""
        read = self.spark.read.schema(f"{EVENTS}, poll long").parquet(f"{self.state}/events")
        return read.where(F.col("poll") <= self.last_poll())
