"""What the physical plans must and must not hold."""

import pytest

from emberwatch.plans import catalog


def plan(spark, sf, name):
    df = catalog.REGISTRY[name](spark, sf)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "normalize_siem_alerts", "normalize_csv_rows", "parse_timestamps", "adapter_defaults",
    "ip_classes", "ip_classes_v6", "synthetic_events", "score_report",
])
def test_row_work_needs_no_shuffle_and_no_python(spark, sf, name):
    text = plan(spark, sf, name)
    for word in ("Python", "ArrowEval", "SortMergeJoin"):
        assert word not in text
    main = text.split("BroadcastExchange")[0]
    assert "Exchange hashpartitioning" not in main and "Exchange SinglePartition" not in main


@pytest.mark.parametrize("name, joins", [
    ("features", 1), ("blocklist_flag", 1), ("blocklist_semi", 1), ("blocklist_cidr", 4)])
def test_small_lists_are_broadcast(spark, sf, name, joins):
    text = plan(spark, sf, name)
    assert text.count("BroadcastHashJoin") == joins
    assert "SortMergeJoin" not in text and "NestedLoop" not in text and "Cartesian" not in text


@pytest.mark.parametrize("name", sorted(
    n for n in catalog.REGISTRY
    if not n.startswith(("model_", "stream_")) and n not in (
        "csv_logs_to_json", "json_alert_scan", "replay_sink")))
def test_no_cross_joins(spark, sf, name):
    text = plan(spark, sf, name)
    assert "Cartesian" not in text and "NestedLoop" not in text


@pytest.mark.parametrize("name", [
    "recent_alerts_topn", "recent_events_buffer", "recent_events_tail", "alert_results_poll",
    "report_preview", "replay_selection"])
def test_limits_are_top_k(spark, sf, name):
    text = plan(spark, sf, name)
    assert "TakeOrderedAndProject" in text and "CollectLimit" not in text


def test_columns_and_filters_reach_the_scan(spark, sf):
    text = plan(spark, sf, "severity_kpis_24h")
    assert "PushedFilters: [IsNotNull(ts), GreaterThan(ts" in text
    text = plan(spark, sf, "rule_severity")
    assert "value" not in text.split("ReadSchema")[1].split("\n")[0]
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan(spark, sf, "extract_ips_documents")
