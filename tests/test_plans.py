"""Plan-shape checks: pruning reaches the scan, aggregations stay hash-based."""

import os

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from retentio.operators import risk as rk
from retentio.sources import fixtures as fx
from retentio.sources.history import RiskHistory

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_history_prunes_partitions(spark, tmp):
    h = RiskHistory(spark, os.path.join(tmp, "risk"))
    r = spark.createDataFrame([("a", 0.2)], "student_id string, dropout_probability double")
    h.upsert(r, "2024-01-01", "m")
    h.upsert(r, "2024-01-08", "m")
    plan = _plan(h.get("2024-01-08"))
    assert "PartitionFilters: [isnotnull(assessment_date" in plan and "2024-01-08" in plan


def test_pairing_is_hash_aggregate(spark):
    plan = _plan(rk.risk_changes(fx.risk_history(spark, SF), "2024-01-01", "2024-01-29"))
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_scan_reads_only_needed_columns(spark):
    plan = _plan(fx.students(spark, SF).select("student_id", "dropout"))
    assert "ReadSchema: struct<c_custkey:bigint>" in plan
    assert "ReadSchema: struct<o_custkey:bigint,o_orderstatus:string>" in plan


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(st.none(), st.just(float("nan")), st.sampled_from([0.0, 0.3, 0.6, 1.0]),
                          st.floats(min_value=-0.5, max_value=1.5)), min_size=1, max_size=40))
def test_level_counts_partition_valid_rows(spark, probs):
    df = spark.createDataFrame([(float(p) if p is not None else None,) for p in probs], "dropout_probability double")
    df = df.withColumn("risk_level", rk.risk_level("dropout_probability"))
    rows = rk.risk_level_counts(df).collect()
    valid = sum(1 for p in probs if p is not None and p == p and 0 < p <= 1)
    assert sum(r["n_students"] for r in rows) == valid
    assert abs(sum(r["pct"] for r in rows) - 100.0 * valid / len(probs)) < 1e-9
