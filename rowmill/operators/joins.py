"""Equi-joins whose strategy follows from the measured size of the looked-up side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

MAX_BROADCAST_ROWS = 500_000
MAX_BROADCAST_BYTES = 64 << 20
SALTS = 16
#: A key is frequent beyond one in HOT_SHARE of the rows; the summary that finds them tracks HOT_TRACKED items.
HOT_SHARE, HOT_TRACKED = 200, 4096
#: Stretches of a bin of ranges, and bins at most (beyond that bins get longer).
BIN_STRETCHES, MAX_BINS = 256, 1 << 15


def row_bytes(df: DataFrame) -> Column:
    """Rough size of a row: text by its length, nested values by their JSON text, the rest 16 bytes."""
    total = F.lit(16)
    for field in df.schema.fields:
        kind = field.dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            part = F.octet_length(F.col(f"`{field.name}`")) + 16
        elif isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
            part = F.octet_length(F.to_json(F.struct(F.col(f"`{field.name}`")))) + 16
        else:
            part = F.lit(16)
        total = total + F.coalesce(part, F.lit(16))
    return total


def fits_in_memory(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS,
                   max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """Whether ``df`` is small enough to broadcast; reads at most ``max_rows + 1`` rows."""
    size = (
        df.limit(max_rows + 1)
        .agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(row_bytes(df)), F.lit(0)).alias("b"))
        .first()
    )
    return size["n"] <= max_rows and size["b"] <= max_bytes


def hot_hashes(df: DataFrame, names: list[str]) -> list[int]:
    """Hashes of the keys that hold more than 1 / HOT_SHARE of the rows, by a frequent-items summary merged over all tasks.

    At most HOT_SHARE keys are that frequent, and every one of them is among the summary's items. A stream has no such summary.
    """
    if df.isStreaming:
        return []
    found = df.select(F.xxhash64(*names).alias("h")).agg(
        F.expr(f"approx_top_k(h, {HOT_SHARE}, {HOT_TRACKED})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    return [item["item"] for item in found["top"] or [] if item["count"] * HOT_SHARE > found["n"]]


def lookup_join(left: DataFrame, right: DataFrame, on, how: str = "left", null_safe: bool = False,
                small: bool | None = None) -> DataFrame:
    """Join ``right`` (one row per key) to ``left``: broadcast when it is small, else shuffled, frequent keys over many tasks.

    Only the rows of keys that a summary of ``left`` finds frequent get a salt, and only those rows of ``right`` are copied,
    once per salt: HOT_SHARE keys at most. The salt is the task's partition number, which a repeated task keeps.
    ``null_safe`` lets null match null. The key columns of ``right`` are dropped. With a stream nothing is measured.
    """
    names = [on] if isinstance(on, str) else list(on)
    if small is None:
        small = not right.isStreaming and fits_in_memory(right)
    renamed = right
    for name in names:
        renamed = renamed.withColumnRenamed(name, f"_r_{name}")
    condition = F.lit(True)
    for name in names:
        lhs, rhs = F.col(name), F.col(f"_r_{name}")
        condition = condition & (lhs.eqNullSafe(rhs) if null_safe else lhs == rhs)
    keys = [f"_r_{name}" for name in names]
    if small:
        return left.join(F.broadcast(renamed), condition, how).drop(*keys)
    same = all(left.schema[n].dataType == right.schema[n].dataType for n in names)  # equal values of other types hash apart
    hot = hot_hashes(left, names) if same else []
    if not hot:
        return left.join(renamed, condition, how).drop(*keys)
    is_hot = lambda columns: F.xxhash64(*columns).isin(hot)
    salted = left.withColumn("_salt", F.when(is_hot(names), F.pmod(F.spark_partition_id(), F.lit(SALTS))).otherwise(0))
    copies = renamed.withColumn("_r_salt", F.explode(F.when(is_hot(keys), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    condition = condition & (F.col("_salt") == F.col("_r_salt"))
    return salted.join(copies, condition, how).drop("_salt", "_r_salt", *keys)


def first_per_key(df: DataFrame, keys, order_by) -> DataFrame:
    """The first row of every key in the order of ``order_by``.

    Spark keeps one row per key in every task before the shuffle, so a frequent key stays cheap.
    """
    from rowmill.operators.index import as_columns

    window = Window.partitionBy(*as_columns(keys)).orderBy(*as_columns(order_by))
    return df.withColumn("_nth", F.row_number().over(window)).where("_nth = 1").drop("_nth")


def orderable(df: DataFrame, but: list[str]) -> list[Column]:
    """All columns that can be compared, except ``but``, values before nulls: an order for rows that came in none."""
    nested = lambda kind: (
        isinstance(kind, (T.MapType, T.VariantType)) or (isinstance(kind, T.ArrayType) and nested(kind.elementType))
        or (isinstance(kind, T.StructType) and any(nested(f.dataType) for f in kind.fields)))
    names = [f.name for f in df.schema.fields if f.name not in but and not nested(f.dataType)] or list(but)
    return [F.col(f"`{name}`").asc_nulls_last() for name in names]


def not_in(df: DataFrame, known: DataFrame, on) -> DataFrame:
    """Rows whose key does not occur in ``known``."""
    names = [on] if isinstance(on, str) else list(on)
    keys = known.select(*names).distinct()
    return lookup_join(df, keys, names, "left_anti")


def is_in(df: DataFrame, known: DataFrame, on) -> DataFrame:
    """Rows whose key occurs in ``known``."""
    names = [on] if isinstance(on, str) else list(on)
    keys = known.select(*names).distinct()
    return lookup_join(df, keys, names, "left_semi")


def merge_lookup(df: DataFrame, source: DataFrame, lookup_key: str, key_field: str,
                 order_by=None) -> DataFrame:
    """Left lookup where every field of the match overwrites the record's, a null one too.

    Where ``source`` repeats a key its first row by ``order_by`` counts (by its other columns, where none is given).
    """
    unique = first_per_key(source, key_field, orderable(source, [key_field]) if order_by is None else order_by)
    packed = unique.select(F.col(key_field).alias(lookup_key), F.struct("*").alias("_match"))
    joined = lookup_join(df, packed, lookup_key, "left")
    hit = F.col("_match").isNotNull()
    columns = []
    for name in df.columns:
        if name in source.columns and name != lookup_key:
            columns.append(F.when(hit, F.col(f"_match.{name}")).otherwise(F.col(name)).alias(name))
        else:
            columns.append(F.col(name))
    extra = [F.col(f"_match.{name}").alias(name) for name in source.columns if name not in df.columns]
    return joined.select(*columns, *extra)


def lookup_field(df: DataFrame, target: str, source: DataFrame, key_field: str,
                 source_key: str | None = None, source_field: str | None = None, order_by=None) -> DataFrame:
    """Add one field of the matching source row; an unknown key gives null.

    Where ``source`` repeats a key its first row by ``order_by`` counts (the smallest value, where none is given).
    """
    source_key = source_key or key_field
    ordered = source if order_by is None else first_per_key(source, source_key, order_by)
    side = ordered.select(F.col(source_key).alias(key_field), F.col(source_field or target).alias("_found"))
    if order_by is None:
        side = first_per_key(side, key_field, orderable(side, [key_field]))
    joined = lookup_join(df.drop(target), side, key_field, "left")
    return joined.withColumnRenamed("_found", target)


def assign_ranges(df: DataFrame, value: str, ranges: DataFrame, low: str, high: str, label: str,
                  target: str) -> DataFrame:
    """Label of the first range (lowest ``low``) with low <= value <= high, from a table of any number of ranges.

    Ranges are made disjoint first: in their order one wins only beyond the highest end before it. Each value then lies in
    one stretch at most. Stretches go into bins of equal number; a value's bin is found by halving the bins' starts (at
    most MAX_BINS values). The values and stretches of a bin are then sorted together, and the stretch begun last before a value
    is its own; so a bin of any length costs a sort. Bins that many values fall into are copied, once per salt. A null
    value or one that no range holds gets null; ranges with a null end or low > high hold nothing.
    """
    stretches = disjoint_stretches(ranges.select(F.col(low).alias("low"), F.col(high).alias("high"), F.col(label).alias("label")))
    total = stretches.agg(F.max("at")).first()[0]
    if total is None:
        return df.withColumn(target, F.lit(None).cast(ranges.schema[label].dataType))
    width = max(BIN_STRETCHES, -(-(total + 1) // MAX_BINS))
    begin = [F.col("start").alias("start"), F.col("open").alias("open")]
    hold = [F.col("high").alias("end"), F.col("label").alias("label")]
    listed = lambda rows, *fields: rows.agg(F.transform(
        F.array_sort(F.collect_list(F.struct("at", F.struct(*fields).alias("_x")))), lambda x: x["_x"])).scalar()
    inside = F.get("_stretches", _last_begun(F.col("_stretches"), F.col(value), width))
    inside = F.when(F.col(value) <= inside["end"], inside["label"])
    if total < width:  # one bin
        return df.withColumn("_stretches", listed(stretches, *begin, *hold)).withColumn(target, inside).drop("_stretches")
    key = df.sparkSession.range(0).select(F.coalesce(F.lit(None).cast(df.schema[value].dataType), F.lit(None).cast(
        stretches.schema["start"].dataType)).alias("k")).schema["k"].dataType  # the type in which both are compared
    firsts = stretches.where(F.col("at") % width == 0).withColumn("start", F.col("start").cast(key))
    placed = df.withColumn("_firsts", listed(firsts, *begin)).withColumn("_sought", F.struct(
        F.col(value).cast(key).alias("start"), F.lit(False).alias("open")))
    placed = placed.withColumn("_bin", _last_begun(  # one comparison a step; a null sorts before all starts
        F.col("_firsts"), F.col(value), total // width + 1, lambda s: s <= F.col("_sought"))).drop("_firsts", "_sought")
    if df.isStreaming:  # a stream is not sorted: its rows get their bin's stretches by a join
        lists = stretches.groupBy(F.floor(F.col("at") / width).cast("int").alias("_bin")).agg(
            F.array_sort(F.collect_list(F.struct(*begin, *hold))).alias("_stretches"))
        return lookup_join(placed, lists, "_bin", "left").withColumn(target, inside).drop("_bin", "_stretches")
    # A value before the first bin finds nothing anywhere, so its rows are dealt over many bins that do not exist.
    own = F.pmod(F.monotonically_increasing_id(), F.lit(1 << 12)).cast("int")
    placed = placed.withColumn("_bin", F.when(F.col("_bin") < 0, -1 - own).otherwise(F.col("_bin")))
    hot = hot_hashes(placed.select("_bin"), ["_bin"])
    is_hot = F.xxhash64("_bin").isin(hot) if hot else F.lit(False)
    binned = stretches.withColumn("_bin", F.floor(F.col("at") / width).cast("int")).select(
        "_bin", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("_salt"),
        F.col("start").cast(key).alias("_at"), F.when(F.col("open"), 2).otherwise(0).alias("_kind"), F.struct(*hold).alias("_hit"))
    sought = placed.select("_bin", F.when(is_hot, F.pmod(own, F.lit(SALTS))).otherwise(0).alias("_salt"), F.col(value).cast(key).alias("_at"),
                           F.lit(1).alias("_kind"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))
    begun = Window.partitionBy("_bin", "_salt").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = (binned.unionByName(sought, allowMissingColumns=True)
             .withColumn("_hit", F.last("_hit", ignorenulls=True).over(begun)).where("_kind = 1"))
    label_of = F.when(F.col("_at") <= F.col("_hit.end"), F.col("_hit.label"))
    kept = {c: F.col(f"_row.`{c}`") for c in df.columns}
    return found.select(*[c.alias(name) for name, c in {**kept, target: label_of}.items()])


def _last_begun(starts: Column, value: Column, most: int, begun=None) -> Column:
    """Position of the last of ascending starts that the value is not before (-1: none), by halving."""
    begun = begun or (lambda s: (s["start"] < value) | ((s["start"] == value) & ~s["open"]))
    steps = [1 << k for k in range(max(most, 1).bit_length(), -1, -1)]
    return F.aggregate(F.array(*[F.lit(k) for k in steps]), F.lit(-1),
                       lambda at, step: F.when(begun(F.get(starts, at + step)), at + step).otherwise(at))


def disjoint_stretches(ranges: DataFrame) -> DataFrame:
    """(at, start, open, high, label): where each range (low, high, label) is the first that holds a value, numbered in order.

    ``open`` tells that the start itself belongs to an earlier range. The highest end before a range is a running
    maximum: within range partitions by a window, over partitions from one value of each.
    """
    from rowmill.operators.index import global_index
    from rowmill.session import shared_dir, shuffle_partitions

    spark = ranges.sparkSession
    shared_dir(spark)
    order = ["low", "high"]
    # Of ranges with the same ends only the first label (a null before others) can win.
    first = F.when(F.count_if(F.col("label").isNull()) == 0, F.min("label")).alias("label")
    laid = (ranges.where("low <= high").groupBy(*order).agg(first).repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
            .withColumn("_part", F.spark_partition_id()).checkpoint())
    tops = laid.groupBy("_part").agg(F.max("high").alias("_top"))  # one row per partition
    earlier = tops.withColumn("_before", F.max("_top").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    known = laid.join(F.broadcast(earlier.drop("_top")), "_part")
    known = known.withColumn("_reach", F.greatest("_before", F.max("high").over(inside)))  # skips nulls
    open_ = F.coalesce(F.col("_reach") >= F.col("low"), F.lit(False))
    won = known.where(F.col("_reach").isNull() | (F.col("high") > F.col("_reach"))).select(
        F.greatest("low", F.when(open_, F.col("_reach"))).alias("start"), open_.alias("open"), "high", "label")
    return global_index(won, ["start", "open"], "at")
