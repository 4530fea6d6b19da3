"""Connected components of a table of links, by rounds of hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rowmill.llm.staging import stage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Columns node, component (the smallest node reachable) of every node that a link names.

    Each round hooks every node to its smallest neighbour, follows these hooks a few steps, and contracts the
    links to the nodes reached; a node that is smaller than all its neighbours keeps its name, so at least half of
    the remaining nodes vanish per round, and a star of any size vanishes in one. All groupings are minima that
    Spark pre-aggregates, every round is a table in the shared folder, and nothing but a row count comes to the
    driver. Links with a null end and links of a node with itself only name their nodes; an empty table gives an
    empty result.
    """
    ends = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    live = stage(ends.where("a is not null and b is not null").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    named = live.select(F.col("a").alias("node")).union(live.select(F.col("b").alias("node"))).distinct()
    named = named.withColumn("component", F.col("node"))
    while True:
        live = live.where("a <> b")
        if live.isEmpty():
            return named
        hooks = live.union(live.select("b", "a")).groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("up"))
        hooks = stage(hooks.select(F.col("a").alias("node"), "up"), "hooks")
        for _ in range(2):
            hooks = _follow(hooks, hooks, "up")
        hooks = stage(hooks, "hooks")
        named = stage(_follow(named, hooks, "component"), "named")
        live = stage(_follow(_follow(live, hooks, "a"), hooks, "b").where("a <> b").select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")


def _follow(df: DataFrame, hooks: DataFrame, column: str) -> DataFrame:
    """Replace a column by what its value hooks to."""
    to = hooks.select(F.col("node").alias("_node"), F.col("up").alias("_up"))
    return (df.join(to, df[column] == F.col("_node"), "left")
            .withColumn(column, F.coalesce("_up", F.col(column))).drop("_node", "_up"))
