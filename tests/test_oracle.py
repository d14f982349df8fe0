import pytest

import __spark_entry__ as entry
from oracle_check import differences, duck

DIR = "/root/testdata/sf0.001"
QUICK = ["merge_measurements", "kernel_signature", "roofline_features", "build_dataset", "validate_efficiency", "build_catalogue", "coverage_report",
         "kernel_shares", "summarise_telemetry", "baseline_table_category", "reconcile", "reconstruct_gap", "transfer_table", "ood_report", "paired_compare",
         "read_captures", "append_measurements", "read_e2e", "catalogue_round_trip", "balanced_shards", "best_epochs", "stream_callbacks"]


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_its_sql(spark, name):
    exact, _, text, _ = differences(entry.queries()[name](spark, DIR), duck(DIR), entry.oracle_sql()[name])
    assert exact, text


def test_registry_is_complete(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 100
    assert entry.entry(spark).columns[:2] == ["category", "gpu_key"]


@pytest.mark.parametrize("name, column, least", [("capture_counts", "category", {"gemm", "conv", "attention", "norm", "elementwise"}), ("clock_comparison", "group", {"MEAN", "POOLED"}), ("seed_summary", "arm", {"a", "b"})])
def test_whole_jobs_match_their_sql(spark, name, column, least):
    found = entry.queries()[name](spark, DIR)
    exact, _, text, _ = differences(found, duck(DIR), entry.oracle_sql()[name])
    assert exact, text
    assert least <= {r[column] for r in found.select(column).distinct().collect()}
