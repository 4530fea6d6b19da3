"""Field profiles, dataset statistics, target types and index hints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from rowmill.functions.numbers import is_integer_text, is_number_text, to_number
from rowmill.functions.text import (
    PATTERNS, is_boolean_text, is_date_text, is_datetime_text, is_time_text, matches)
from rowmill.operators.filters import drop_sample_fields
from rowmill.session import shuffle_partitions

_PREDICATES = {
    "boolean": is_boolean_text,
    "integer": is_integer_text,
    "float": is_number_text,
    "datetime": is_datetime_text,
    "date": is_date_text,
    "time": is_time_text,
}


_NATIVE = ("boolean", "integer", "float", "datetime", "date", "array", "object")


def _native(kind: T.DataType) -> str | None:
    """The profile type of a typed column; text columns are judged by their values."""
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.IntegralType):
        return "integer"
    if isinstance(kind, T.NumericType):
        return "float"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(kind, T.DateType):
        return "date"
    if isinstance(kind, T.ArrayType):
        return "array"
    if isinstance(kind, (T.StructType, T.MapType)):
        return "object"
    return None


def _as_text(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    c = F.col(f"`{name}`")
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType, T.VariantType)):
        return F.to_json(c)
    return c.cast("string")


LONG_TEXT = 128  # longer values are shuffled as a digest, after they were tested and read as numbers


def value_key(c: Column) -> Column:
    """The value, or for long text its sha2 digest; the digest's 129 characters never equal a short value."""
    return F.when(F.length(c) <= LONG_TEXT, c).otherwise(F.concat(F.sha2(c, 512), F.lit("#")))


_BITS = [*_PREDICATES, *[name for name, _ in PATTERNS]]


def _test_bits(value: Column) -> Column:
    """All type predicates and patterns of a text as one number, a bit each."""
    tests = [*[test(value) for test in _PREDICATES.values()], *[matches(value, p) for _, p in PATTERNS]]
    return reduce(lambda a, b: a + b, [F.when(test, 1 << i).otherwise(0) for i, test in enumerate(tests)])


def value_counts(df: DataFrame) -> DataFrame:
    """(name, native type, value or digest, size, test bits and number of long text, count) of every distinct value.

    Values are pre-aggregated per task, whose table holds all distinct values of its rows: rows are dealt over tasks first, as
    a task of a scan may get any number of them. Forms of times are shorter than long text, which so has no moment.
    """
    df = df.repartition(shuffle_partitions(df.sparkSession), F.monotonically_increasing_id())
    # Texts are a projection of their own: used several times below, they are computed once.
    texts = df.select(*[_as_text(df, name).alias(name) for name in df.columns])

    def entry(name: str) -> Column:
        value = F.col(f"`{name}`")
        native = _native(df.schema[name].dataType)
        bits, number = F.lit(None).cast("int"), F.lit(None).cast("double")
        if native is None:
            bits = F.when(F.length(value) > LONG_TEXT, _test_bits(value))
            number = F.when(F.length(value) > LONG_TEXT, to_number(value))
        return F.struct(F.lit(name).alias("name"), F.lit(native).cast("string").alias("native"),
                        value_key(value).alias("value"), F.length(value).alias("size"), bits.alias("bits"),
                        number.alias("number"))

    return (texts.select(F.explode(F.array(*[entry(name) for name in df.columns])).alias("_x")).select("_x.*")
            .groupBy("name", "native", "value", "size", "bits", "number").agg(F.count(F.lit(1)).alias("n")))


def field_profiles(df: DataFrame) -> DataFrame:
    """One row per field, by name: type, nullable, unique, cardinality, ratio, pattern, ranges, lengths.

    Distinct values are counted first (one shuffle); types, patterns and ranges are then judged on the
    distinct values and combined per task, so a frequent value costs no more than a rare one. Null and ''
    do not count for the type; for uniqueness and cardinality only null does not count.
    """
    counted = value_counts(drop_sample_fields(df))
    value, n, native, size = F.col("value"), F.col("n"), F.col("native"), F.col("size")
    typed = value.isNotNull() & (value != "")
    short = typed & (size <= LONG_TEXT)
    number = F.when(short, to_number(value)).otherwise(F.col("number"))
    bits = F.when(typed & native.isNull(), F.coalesce("bits", _test_bits(value)))
    natives = F.array(*[F.lit(kind) for kind in _NATIVE])
    is_time = (native == "datetime") | (F.col("bits").bitwiseAND(1 << _BITS.index("datetime")) != 0)
    moment = F.when(short & is_time, F.unix_micros(F.try_to_timestamp(value)))
    wide = counted.withColumn("bits", bits).groupBy("name").agg(  # fixed-width buffers only, so this stays a hash aggregation
        F.max(F.array_position(natives, native)).alias("native_code"),
        F.sum(n).alias("total"),
        F.coalesce(F.sum(F.when(typed, n)), F.lit(0)).alias("typed"),
        F.coalesce(F.sum(F.when(value.isNotNull(), n)), F.lit(0)).alias("present"),
        F.count(value).alias("cardinality"),
        F.min(number).alias("low"), F.max(number).alias("high"),
        F.min(F.when(typed, size)).alias("short"), F.max(F.when(typed, size)).alias("long"),
        F.min(moment).alias("first_time"), F.max(moment).alias("last_time"),
        F.bit_and("bits").alias("bits"),
    ).withColumn("native", F.get(natives, (F.col("native_code") - 1).cast("int")))
    holds = lambda name: F.col("bits").bitwiseAND(1 << _BITS.index(name)) != 0
    judged = F.lit("string")
    for kind in reversed(list(_PREDICATES)):
        judged = F.when(holds(kind), kind).otherwise(judged)
    kind = F.when(F.col("typed") == 0, "null").otherwise(F.coalesce(native, judged))
    pattern = F.lit(None).cast("string")
    for name, _ in reversed(PATTERNS):
        pattern = F.when(holds(name), name).otherwise(pattern)
    numeric, text, time = F.col("type").isin("integer", "float"), F.col("type") == "string", F.col("type") == "datetime"
    return wide.withColumn("type", kind).select(
        "name", "type",
        ((F.col("type") == "null") | (F.col("typed") < F.col("total"))).alias("nullable"),
        (F.col("present") == F.col("cardinality")).alias("unique"),
        "cardinality",
        F.when(F.col("present") > 0, F.col("cardinality") / F.col("present")).otherwise(0.0).alias("cardinality_ratio"),
        F.when(numeric, F.col("low")).alias("min"), F.when(numeric, F.col("high")).alias("max"),
        F.when(time, F.timestamp_micros("first_time").cast("string")).alias("min_time"),
        F.when(time, F.timestamp_micros("last_time").cast("string")).alias("max_time"),
        F.when(text, F.col("short")).when(F.col("type") == "null", 0).alias("min_length"),
        F.when(text, F.col("long")).when(F.col("type") == "null", 0).alias("max_length"),
        F.when(text, pattern).alias("pattern"),
        "total", (F.col("total") - F.col("present")).alias("null_count"),
    )


def sample_values(df: DataFrame, order_by, limit: int = 10) -> DataFrame:
    """The first ``limit`` non-null values of every field, in order, as (name, position, value).

    One bounded top-k per field; each reads only its own column and the order key.
    """
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    source = drop_sample_fields(df)
    per_field = []
    for name in source.columns:
        first = (
            source.where(F.col(f"`{name}`").isNotNull())
            .select(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)]).alias("_o"),
                    _as_text(source, name).alias("value"))
            .orderBy("_o").limit(limit)
        )
        ordered = first.agg(F.array_sort(F.collect_list(F.struct("_o", "value"))).alias("_all"))
        per_field.append(ordered.select(F.lit(name).alias("name"), F.posexplode("_all").alias("position", "_x"))
                         .select("name", F.col("position").cast("long"), F.col("_x.value").alias("value")))
    return reduce(DataFrame.unionByName, per_field)


def dataset_statistics(df: DataFrame) -> DataFrame:
    """One row: total_records, total_fields, duplicate_records."""
    source = drop_sample_fields(df)
    whole = F.sha2(F.to_json(F.struct(*[_as_text(source, c).alias(c) for c in sorted(source.columns)])), 256)
    copies = source.groupBy(whole.alias("record")).agg(F.count(F.lit(1)).alias("n"))
    return copies.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_records"),
                      F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_records")).select(
        "total_records", F.lit(len(source.columns)).cast("long").alias("total_fields"), "duplicate_records")


def missing_values(df: DataFrame) -> DataFrame:
    """(name, missing) of every field that has nulls, in one pass."""
    source = drop_sample_fields(df)
    row = source.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"m{i}") for i, c in enumerate(source.columns)])
    entries = [F.struct(F.lit(c).alias("name"), F.col(f"m{i}").alias("missing")) for i, c in enumerate(source.columns)]
    return row.select(F.explode(F.array(*entries)).alias("_x")).select("_x.*").where("missing > 0")


# ---- target types ---------------------------------------------------------------------------------

# The type names of five targets by the profiler's types.
TARGET_TYPES = {
    "sqlite": {
        "null": "TEXT", "boolean": "INTEGER", "integer": "INTEGER", "float": "REAL", "string": "TEXT",
        "array": "TEXT", "object": "TEXT", "datetime": "TEXT", "date": "TEXT", "time": "TEXT", "uuid": "TEXT",
        "email": "TEXT", "url": "TEXT", "phone": "TEXT", "ipv4": "TEXT", "json": "TEXT",
    },
    "postgresql": {
        "null": "TEXT", "boolean": "BOOLEAN", "integer": "INTEGER", "float": "DOUBLE PRECISION", "string": "VARCHAR",
        "array": "JSONB", "object": "JSONB", "datetime": "TIMESTAMP", "date": "DATE", "time": "TIME", "uuid": "UUID",
        "email": "VARCHAR(255)", "url": "VARCHAR(500)", "phone": "VARCHAR(20)", "ipv4": "INET", "json": "JSONB",
    },
    "mysql": {
        "null": "TEXT", "boolean": "TINYINT(1)", "integer": "INT", "float": "DOUBLE", "string": "VARCHAR",
        "array": "JSON", "object": "JSON", "datetime": "DATETIME", "date": "DATE", "time": "TIME", "uuid": "CHAR(36)",
        "email": "VARCHAR(255)", "url": "VARCHAR(500)", "phone": "VARCHAR(20)", "ipv4": "VARCHAR(45)", "json": "JSON",
    },
    "sqlserver": {
        "null": "NVARCHAR(MAX)", "boolean": "BIT", "integer": "INT", "float": "FLOAT", "string": "NVARCHAR",
        "array": "NVARCHAR(MAX)", "object": "NVARCHAR(MAX)", "datetime": "DATETIME2", "date": "DATE", "time": "TIME",
        "uuid": "UNIQUEIDENTIFIER", "email": "NVARCHAR(255)", "url": "NVARCHAR(500)", "phone": "NVARCHAR(20)",
        "ipv4": "NVARCHAR(45)", "json": "NVARCHAR(MAX)",
    },
    "mongodb": {
        "null": "null", "boolean": "bool", "integer": "int", "float": "double", "string": "string", "array": "array",
        "object": "object", "datetime": "date", "date": "date", "time": "string", "uuid": "string", "email": "string",
        "url": "string", "phone": "string", "ipv4": "string", "json": "object",
    },
}

# Integer types by target, narrowest first, with the range each holds.
_INTEGERS = {
    "postgresql": [("SMALLINT", -2**15, 2**15 - 1), ("INTEGER", -2**31, 2**31 - 1)],
    "mysql": [("TINYINT UNSIGNED", 0, 255), ("TINYINT", -2**7, 2**7 - 1), ("SMALLINT", -2**15, 2**15 - 1),
              ("MEDIUMINT", -2**23, 2**23 - 1), ("INT", -2**31, 2**31 - 1)],
    "sqlserver": [("TINYINT", 0, 255), ("SMALLINT", -2**15, 2**15 - 1), ("INT", -2**31, 2**31 - 1)],
}


def integer_type(low: Column, high: Column, target: str) -> Column:
    """The narrowest integer type that holds both bounds."""
    if target not in _INTEGERS:
        return F.lit("INTEGER")
    chosen = F.lit("BIGINT")
    for name, least, most in reversed(_INTEGERS[target]):
        chosen = F.when((low >= least) & (high <= most), name).otherwise(chosen)
    return chosen


def target_types(profiles: DataFrame, target: str = "sqlite") -> DataFrame:
    """name, source_type, target_type, constraints and nullable of every profiled field."""
    if target not in TARGET_TYPES:
        raise ValueError(f"unknown target {target}; one of {', '.join(TARGET_TYPES)}")
    names = F.create_map(*[F.lit(x) for pair in TARGET_TYPES[target].items() for x in pair])
    mapped = F.coalesce(F.element_at(names, F.col("type")), F.lit("TEXT"))
    length = F.coalesce(F.col("max_length"), F.lit(255))
    sized = F.when(mapped.isin("VARCHAR", "NVARCHAR") & (length > 0),
                   F.concat(mapped, F.lit("("), length.cast("string"), F.lit(")"))).otherwise(mapped)
    bounded = (F.col("type") == "integer") & F.col("min").isNotNull()
    constraints = F.filter(F.array(F.when(~F.col("nullable"), "NOT NULL"), F.when(F.col("unique"), "UNIQUE")),
                           lambda x: x.isNotNull())
    return profiles.select(
        "name", F.col("type").alias("source_type"),
        F.when(bounded, integer_type(F.col("min"), F.col("max"), target)).otherwise(sized).alias("target_type"),
        F.array_join(constraints, " ").alias("constraints"), "nullable")


def create_table_text(fields: DataFrame, table: str = "data") -> DataFrame:
    """One row with the CREATE TABLE text; there is one line per field."""
    line = F.concat(F.lit("  "), F.col("name"), F.lit(" "), F.col("target_type"),
                    F.when(F.col("constraints") != "", F.concat(F.lit(" "), F.col("constraints"))).otherwise(""))
    lines = F.array_sort(F.collect_list(F.struct("name", line.alias("text"))))
    body = F.array_join(F.transform(lines, lambda x: x["text"]), ",\n")
    return fields.agg(F.concat(F.lit(f"CREATE TABLE {table} (\n"), body, F.lit("\n);")).alias("create_sql"))


def index_hints(profiles: DataFrame) -> DataFrame:
    """A unique index for unique fields, a plain one where over 0.9 of the values are distinct."""
    high = F.col("cardinality_ratio") > 0.9
    return profiles.where(F.col("unique") | high).select(
        F.concat(F.lit("idx_"), F.col("name")).alias("name"), F.col("name").alias("field"), "unique",
        F.when(F.col("unique"), "Unique field").otherwise("High cardinality").alias("reason"))


def profile_hints(profiles: DataFrame, enum_limit: int = 20) -> DataFrame:
    """Hints per field: mostly null (over half), or few enough values for a CHECK constraint."""
    share = F.when(F.col("total") > 0, F.col("null_count") / F.col("total")).otherwise(0.0)
    few = (F.col("type") == "string") & (F.col("cardinality") <= enum_limit) & (F.col("cardinality") > 0)
    return profiles.select("name", (share > 0.5).alias("mostly_null"), few.alias("enum_check"))


def type_conflicts(df: DataFrame) -> DataFrame:
    """(name, value_type, values) where a text field mixes integers, floats, times and other text."""
    value, bits = F.col("value"), F.col("bits")
    kind = F.lit("string")
    for name in reversed(["integer", "float", "datetime", "date", "time"]):
        tested = bits.bitwiseAND(1 << _BITS.index(name)) != 0  # bits of the whole text, where value is its digest
        kind = F.when(F.when(bits.isNull(), _PREDICATES[name](value)).otherwise(tested), name).otherwise(kind)
    typed = (value_counts(drop_sample_fields(df)).where(F.col("native").isNull() & F.col("size").isNotNull() & (value != ""))
             .groupBy("name", kind.alias("value_type")).agg(F.sum("n").alias("values")))
    mixed = typed.groupBy("name").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("name")
    return typed.join(mixed, "name", "left_semi")
