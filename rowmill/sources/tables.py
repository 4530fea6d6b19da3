"""Named tables: store, load, update, delete, exists on Spark's catalog.

A table is a view over its current version, a Parquet table in its own folder below ``location``. Update, delete and
overwrite write a new version and then replace the view in one call of the catalog, so the table exists throughout, with
the old rows and columns or with the new ones. The view's properties list the versions that are kept, newest first.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from rowmill.operators.filters import equals_all
from rowmill.operators.joins import first_per_key, not_in, orderable
from rowmill.session import staged_path
from rowmill.sources.folders import remove_folder

EXPIRES = "_expires_at"
MANIFEST = "rowmill.versions"


class TableStore:
    """``keep`` versions of a table stay readable after a change (2: readers of the one before may end their work)."""

    def __init__(self, spark: SparkSession, location: str | None = None, keep: int = 2):
        if keep < 1:
            raise ValueError("at least the current version is kept")
        self.spark = spark
        self.location = location or staged_path(spark, "tables")
        self.keep = keep

    def exists(self, table: str) -> bool:
        return self.spark.catalog.tableExists(table)

    def history(self, table: str) -> list[dict]:
        """number, table, folder and written_at of the kept versions, newest first."""
        if not self.exists(table):
            return []
        properties = {r["key"]: r["value"] for r in self.spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}
        return json.loads(properties.get(MANIFEST, "[]"))

    def _publish(self, table: str, df: DataFrame) -> None:
        """Write a new version, point the table at it, then drop the versions beyond ``keep``."""
        known = self.history(table)
        if self.exists(table) and not known:
            raise ValueError(f"{table} was not made by a table store")
        name = uuid.uuid4().hex
        version = {"number": known[0]["number"] + 1 if known else 1, "table": f"{table}__{name}",
                   "folder": f"{self.location}/{table}/{name}", "written_at": int(time.time())}
        df.write.format("parquet").option("path", version["folder"]).saveAsTable(version["table"])
        versions = [version, *known]
        manifest = json.dumps(versions[:self.keep]).replace("\\", "\\\\").replace("'", "\\'")
        replace = "OR REPLACE " if known else ""
        self.spark.sql(f"CREATE {replace}VIEW {table} TBLPROPERTIES ('{MANIFEST}' = '{manifest}') AS SELECT * FROM {version['table']}")
        for old in versions[self.keep:]:
            self.spark.sql(f"DROP TABLE IF EXISTS {old['table']}")
            remove_folder(self.spark, old["folder"])

    def drop(self, table: str) -> None:
        """Remove a table with all its versions; a missing one is no error."""
        known = self.history(table)
        if known:
            self.spark.sql(f"DROP VIEW {table}")
        for old in known:
            self.spark.sql(f"DROP TABLE IF EXISTS {old['table']}")
            remove_folder(self.spark, old["folder"])

    def store(self, table: str, df: DataFrame) -> None:
        """Create the table or append to it; extra fields are dropped, missing ones null, no rows do nothing."""
        if df.isEmpty():
            return
        if not self.exists(table):
            self._publish(table, df)
            return
        known = self.history(table)
        current = known[0]["table"] if known else table
        schema = self.spark.table(current).schema
        aligned = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                              for f in schema.fields])
        aligned.write.insertInto(current)

    def store_new(self, table: str, df: DataFrame, key: list[str], order_by=None) -> None:
        """Append only rows whose key is not in the table yet; of equal new keys the first by ``order_by`` (all columns) is kept."""
        unique = first_per_key(df, key, orderable(df, key) if order_by is None else order_by)
        self.store(table, not_in(unique, self.load(table), key) if self.exists(table) else unique)

    def overwrite(self, table: str, df: DataFrame, ttl_seconds: int | None = None) -> None:
        """Replace the whole table, whatever its columns; with a time to live its rows are not loaded after that."""
        if ttl_seconds is not None:
            df = df.withColumn(EXPIRES, F.current_timestamp() + F.make_dt_interval(secs=F.lit(ttl_seconds)))
        self._publish(table, df)

    def load(self, table: str, query: dict | None = None, number: int | None = None) -> DataFrame:
        """Rows whose fields equal all of ``query``; the scan gets the filter. ``number`` asks for a kept earlier version."""
        source = table
        if number is not None:
            kept = {v["number"]: v["table"] for v in self.history(table)}
            if number not in kept:
                raise ValueError(f"version {number} of {table} is not kept: {sorted(kept)}")
            source = kept[number]
        df = self.spark.table(source)
        if EXPIRES in df.columns:
            df = df.where(F.col(EXPIRES).isNull() | (F.col(EXPIRES) > F.current_timestamp())).drop(EXPIRES)
        return df.where(equals_all(query)) if query else df

    def _rewrite(self, table: str, query: dict, changed) -> int:
        match = F.coalesce(equals_all(query), F.lit(False))
        seen = Observation()
        marked = self.spark.table(table).observe(seen, F.count_if(match).alias("hits"))
        self._publish(table, changed(marked, match))
        return seen.get["hits"] or 0

    def update(self, table: str, query: dict, data: dict) -> int:
        """Set the fields of ``data`` where ``query`` matches; an empty query or data changes nothing."""
        if not query or not data or not self.exists(table):
            return 0
        kinds = {f.name: f.dataType for f in self.spark.table(table).schema.fields}
        return self._rewrite(table, query, lambda df, match: df.withColumns({
            name: F.when(match, F.lit(value).cast(kinds[name])).otherwise(F.col(name))
            for name, value in data.items() if name in kinds}))

    def delete(self, table: str, query: dict) -> int:
        """Delete the rows where ``query`` matches; an empty query deletes nothing."""
        if not query or not self.exists(table):
            return 0
        return self._rewrite(table, query, lambda df, match: df.where(~match))
