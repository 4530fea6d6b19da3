"""Enrich, transform, validate and aggregate from one configuration."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from rowmill.operators.aggregate import aggregate
from rowmill.operators.encoding import encode
from rowmill.operators.enrich import enrich, rules_from_config
from rowmill.operators.filters import filter_rows
from rowmill.operators.reshape import melt, nest, pivot
from rowmill.operators.scaling import normalize
from rowmill.operators.validate import checks_from_config, error_rows, summarize, with_errors


@dataclass
class Result:
    """Lazy outputs of a run; the caller decides what to write."""

    records: DataFrame
    steps_completed: list[str] = field(default_factory=list)
    errors: DataFrame | None = None
    summary: DataFrame | None = None


def _reshape(df: DataFrame, config: dict, order_by) -> DataFrame:
    if config.get("operation", "pivot") == "pivot":
        return _pivot(df, config, order_by)
    if config["operation"] == "melt":
        return melt(df, config.get("id_vars", []), config.get("value_vars", []))
    return df


def _pivot(df: DataFrame, config: dict, order_by) -> DataFrame:
    return pivot(df, config["index"], config["columns"], config["values"], order_by, config.get("column_values"))


TRANSFORMS = {
    "normalize": lambda df, c, o: normalize(df, c.get("fields", []), c.get("method", "min_max"), c.get("bounds")),
    "encode": lambda df, c, o: encode(df, c["field"], c.get("method", "label"), c.get("target")),
    "reshape": _reshape,
    "pivot": _pivot,
    "melt": lambda df, c, o: melt(df, c.get("id_vars", []), c.get("value_vars", [])),
    "nest": lambda df, c, o: nest(df, c["group_by"], c["nest_fields"], o),
    "filter": lambda df, c, o: filter_rows(df, c.get("condition")),
    "aggregate": lambda df, c, o: aggregate(df, c["group_by"], c["aggregations"], o),
}


def transform(df: DataFrame, strategy: str, config: dict | None = None, order_by=None) -> DataFrame:
    """One transformation by name; an unknown name changes nothing."""
    step = TRANSFORMS.get(strategy)
    return df if step is None else step(df, config or {}, order_by)


def run(df: DataFrame, config: dict, order_by=None, lookups: dict[str, DataFrame] | None = None) -> Result:
    """``config`` may hold enrichment, transformation, validation and aggregation, which run in this order.

    Validation never drops records. ``order_by`` (a unique key) is needed by steps that depend on order.
    """
    result = Result(df)
    if "enrichment" in config:
        rules = rules_from_config(config["enrichment"], lookups)
        if rules:
            result.records = enrich(result.records, rules)
            result.steps_completed.append("enrichment")
    if "transformation" in config:
        for step in config["transformation"]:
            result.records = transform(result.records, step.get("type", "normalize"), step, order_by)
        result.steps_completed.append("transformation")
    if "validation" in config:
        checks = checks_from_config(config["validation"])
        result.errors = error_rows(result.records, checks)
        result.summary = summarize(with_errors(result.records, checks))
        result.steps_completed.append("validation")
    if "aggregation" in config:
        wanted = config["aggregation"]
        result.records = aggregate(result.records, wanted["group_by"], wanted["aggregations"], order_by)
        result.steps_completed.append("aggregation")
    return result
