"""Sample, profile and noise labels in one go."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from rowmill.operators.filters import drop_sample_fields
from rowmill.operators.noise import noise_labels, noise_report
from rowmill.operators.profile import dataset_statistics, field_profiles
from rowmill.operators.sampling import sample
from rowmill.session import shared_dir


@dataclass
class SampleReport:
    records: DataFrame                    # _id, _source
    original_count: int
    sample_size: int
    strategy: str
    fields: DataFrame | None = None
    statistics: DataFrame | None = None
    labels: DataFrame | None = None
    noise: DataFrame | None = None


def sample_with_analysis(df: DataFrame, size: int, order_by, strategy: str = "random", analyze: bool = True,
                         detect_noise: bool = False, **options) -> SampleReport:
    """The sample is checkpointed once; profile and labels then read it several times."""
    shared_dir(df.sparkSession)
    sampled = sample(df, size, order_by, strategy, **options).checkpoint()
    records = sampled.select(F.concat(F.lit("sample_"), F.col("_sample_index").cast("string")).alias("_id"),
                             F.struct(*sampled.columns).alias("_source"))
    report = SampleReport(records, df.count(), size, strategy)
    plain = drop_sample_fields(sampled)
    if analyze:
        report.fields, report.statistics = field_profiles(plain), dataset_statistics(plain)
    if detect_noise:
        report.labels = noise_labels(plain, order_by)
        report.noise = noise_report(plain, report.labels, order_by)
    return report
