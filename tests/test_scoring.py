import pytest
from pyspark.sql import functions as F

from emberwatch.functions.scoring import (
    band_of, destination_security, label_of, port_security, source_security, to_severity,
)
from emberwatch.operators.dashboard import dashboard_table, severity_kpis
from emberwatch.operators.results import report_lines
from emberwatch.operators.scoring import with_features, with_rule_severity
from emberwatch.schemas import DASHBOARD_ALERT

# source, destination, port, level; source, destination and port feature; severity, label
EVENTS = [
    ("192.168.7.9", "10.0.0.44", 3306, 4, 0, 8, 5, 37, "suspicious"),
    ("172.20.3.3", "10.0.0.44", 8080, 9, 0, 8, 5, 57, "malicious"),
    ("77.88.55.60", "10.0.0.9", 22, 11, 3, 8, 5, 71, "malicious"),
    ("81.2.69.142", "10.0.0.9", 443, 15, 3, 8, 5, 87, "critical"),
    ("10.1.2.3", "10.0.0.30", 443, 7, 0, 8, 5, 49, "suspicious"),
    ("192.0.2.44", "10.0.0.9", 8443, 6, 0, 8, 0, 40, "suspicious"),
    ("172.31.0.4", "10.0.0.2", 22, 1, 0, 8, 5, 25, "suspicious"),
    ("62.4.5.6", "10.0.0.9", 90, 12, 3, 8, 5, 75, "critical"),
]


@pytest.fixture(scope="module")
def scored(spark):
    events = spark.createDataFrame(
        [(i, *e[:4]) for i, e in enumerate(EVENTS)],
        "i int, source_ip string, destination_ip string, port int, level int",
    ).withColumn("listed", F.lit(False))
    return with_rule_severity(with_features(events))


def test_sample_events(scored):
    rows = scored.orderBy("i").collect()
    seen = [(r.source_ip_security, r.destination_ip_security, r.port_security, r.severity, r.label)
            for r in rows]
    assert seen == [e[4:] for e in EVENTS]
    assert {r.status for r in rows} == {"scored"}


def test_report_table(scored):
    line = report_lines(scored.filter("i = 0")).first()[0]
    assert line == (
        "  4        192.168.7.9        10.0.0.44          3306     37       suspicious   scored"
    )


@pytest.mark.parametrize("ip, listed, points", [
    (None, False, 3), ("01.2.3.4", False, 3), ("999.1.1.1", False, 3), ("100.64.0.1", False, 3),
    ("192.0.0.9", False, 3), ("8.8.8.8", True, 13), ("10.1.1.1", True, 10), ("10.1.1.1", False, 0),
])
def test_source_points(spark, ip, listed, points):
    df = spark.createDataFrame([(ip,)], "ip string")
    assert df.select(source_security(F.col("ip"), F.lit(listed))).first()[0] == points


@pytest.mark.parametrize("ip, points", [
    ("10.0.0.300", 5), ("192.168.1.100", 8), ("192.168.1.2", 3), ("8.8.8.8", 0), (None, 0),
])
def test_destination_points(spark, ip, points):
    df = spark.createDataFrame([(ip,)], "ip string")
    assert df.select(destination_security(F.col("ip"))).first()[0] == points


def test_ports_bands_and_clip(spark):
    ports = spark.createDataFrame([(p,) for p in (22, 90, 80, None)], "p int")
    assert [r[0] for r in ports.select(port_security(F.col("p"))).collect()] == [5, 5, 0, 0]
    assert [r[0] for r in ports.select(port_security(F.col("p"), [80])).collect()] == [0, 0, 5, 0]
    raw = spark.createDataFrame([(-3.0,), (24.99,), (100.5,), (float("nan"),), (None,)], "x double")
    clipped = raw.select(to_severity(F.col("x")).alias("s")).select("s", label_of(F.col("s")))
    assert [tuple(r) for r in clipped.collect()] == [
        (0, "benign"), (24, "benign"), (100, "critical"), (None, None), (None, None)]
    scores = spark.createDataFrame([(s,) for s in (80, 79, 60, 59, 40, 39)], "s int")
    assert [r[0] for r in scores.select(band_of(F.col("s"))).collect()] == [
        "critical", "high", "high", "medium", "medium", "low"]


# Severity word and score, with scores at and beside the bounds of the bands.
SAMPLE = [("critical", 91), ("high", 62), ("medium", 84), ("low", 40), ("critical", 80),
          ("high", 79), ("medium", 59), ("low", 12), ("low", 33)]



def test_dashboard_sample(spark):
    rows = [(f"EVT-{i:03d}", "t", "e", "ip", "u", word, score, "open", "m")
            for i, (word, score) in enumerate(SAMPLE, start=1)]
    alerts = spark.createDataFrame(rows, DASHBOARD_ALERT)
    assert severity_kpis(alerts).first().asDict() == {
        "total": 9, "critical": 2, "high": 2, "medium": 2, "low": 3}
    bands = alerts.withColumn("severity", band_of(F.col("score")))
    assert severity_kpis(bands).first().asDict() == {
        "total": 9, "critical": 3, "high": 2, "medium": 2, "low": 2}
    assert "message" not in dashboard_table(alerts).columns
