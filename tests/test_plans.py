"""The plans the operators are meant to have."""

from pyspark.sql import functions as F

from rowmill.operators import aggregate, joins, noise, reshape, sampling, scaling
from rowmill.plans.value_add import run
from suite.flagship import CONFIG
from tests.conftest import plan_of


def test_one_exchange_and_pruned_scan_for_the_configured_run(load):
    plan = plan_of(run(load("lineitem"), CONFIG).records)
    assert plan.count("Exchange") == 1 and "l_tax" not in plan
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity" in plan


def test_first_per_key_is_limited_before_the_shuffle(load):
    assert "WindowGroupLimit" in plan_of(joins.first_per_key(load("documents"), "source", "doc_id"))


def test_small_lookup_is_broadcast(load):
    plan = plan_of(joins.lookup_field(load("customer"), "n_name", load("nation"), "c_nationkey", "n_nationkey"))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_salted_join_shuffles_by_salt(load):
    plan = plan_of(joins.lookup_join(load("customer"), load("nation").withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey", small=False))
    assert "_salt" in plan


def test_random_sample_is_a_top_k(load):
    assert "TakeOrderedAndProject" in plan_of(sampling.random_sample(load("events"), 10, "event_id"))


def test_scaling_does_not_shuffle_the_rows(load):
    plan = plan_of(scaling.normalize(load("lineitem"), ["l_quantity", "l_tax"], "z_score"))
    outside = plan.split("Subqueries")[0]
    assert "Window" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan and "hashpartitioning" not in outside


def test_aggregates_are_hashed_where_buffers_allow(load):
    plan = plan_of(noise.key_duplicates(load("events"), ["user_id"], "event_id"))
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_pivot_reduces_pairs_first(load):
    plan = plan_of(reshape.pivot(load("events"), "user_id", "event_type", "value", "event_id"))
    assert "pivotfirst" in plan.lower()


def test_no_window_over_a_whole_table(load):
    labels = noise.noise_labels(load("events").select("event_id", "event_type", "value"), "event_id")
    assert "Window" not in plan_of(labels)
    listed = aggregate.aggregate(load("events"), ["user_id"], {"m": "mode,event_type"}, "event_id")
    assert "Window" not in plan_of(listed) and "SinglePartition" not in plan_of(listed.where(F.col("m").isNotNull()))
