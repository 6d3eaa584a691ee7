import json

import pytest
from pyspark.sql import functions as F

from emberwatch.functions.text import pad_left
from emberwatch.operators.normalize import (
    field_value, fill_defaults, normalize_alerts, normalize_fields, normalize_logs, row_json,
)
from emberwatch.operators.results import run_once
from emberwatch.operators.sinks import write_json, write_json_array, write_results
from emberwatch.schemas import ALERT, FIELD_LOG, RAW_LOG
from emberwatch.sources.alerts import newest_alerts, parse_envelopes, read_alerts, read_envelopes
from emberwatch.sources.logs import read_log_csv

AS_OF = "2026-06-01T00:00:00Z"
# One record per rule of the normaliser, each with only the fields that the rule looks at, and what
# it becomes: address pair, port, then the port that scoring fills in.
CASES = {
    "given source beside two in the log": (
        {"data": {"srcip": "203.9.9.1"}, "full_log": "drop 5.5.1.1 > 5.5.1.2 > 5.5.1.3"},
        ("203.9.9.1", "5.5.1.2", None), 0),
    "both out of the log": (
        {"full_log": "accept 61.2.3.4:99 to 61.2.3.5", "agent": {"ip": "10.9.9.9"}},
        ("61.2.3.4", "61.2.3.5", None), 0),
    "agent stands in for the target": (
        {"full_log": "logout at 61.2.3.4", "agent": {"ip": "10.9.9.9", "name": "vault"}},
        ("61.2.3.4", "10.9.9.9", None), 0),
    "port as a number": ({"data": {"dstport": 8443, "srcport": "1"}}, (None, None, 8443), 8443),
    "port zero": ({"data": {"dstport": 0, "srcport": "515"}}, (None, None, None), 0),
    "source port alone": ({"data": {"srcport": "40404"}}, (None, None, None), 40404),
    "null objects": ({"data": None, "agent": None, "rule": None, "full_log": None},
                     (None, None, None), 0),
}
NETWORK = {
    "@timestamp": "2033-11-05T18:00:00.125+0000",
    "rule": {"groups": ["flow", "denied", "edge"], "level": "14", "id": "fw-9",
             "description": "flow denied at the edge"},
    "data": {"srcport": "40404"},
    "full_log": "deny tcp 61.2.3.4 -> 10.0.0.8 user wren: retry",
}
QUIET = {
    "timestamp": "2033-11-05T17:59:00.000+0000", "full_log": "",
    "rule": {"description": "nightly inventory done", "id": "inv-2", "level": 1, "groups": ["inventory"]},
    "agent": {"ip": "10.0.0.77"},
}


def envelope(*hits):
    return json.dumps({"hits": {"hits": [{"_source": h} for h in hits]}})


def alerts_of(spark, *hits):
    return parse_envelopes(spark.createDataFrame([(envelope(*hits),)], "value string"))


@pytest.mark.parametrize("case", CASES)
def test_addresses_and_ports(spark, case):
    record, want, port = CASES[case]
    events = normalize_alerts(alerts_of(spark, record), AS_OF)
    row = events.first()
    assert (row.source_ip, row.destination_ip, row.port) == want
    assert fill_defaults(events).first().port == port


def test_answer_to_scored_results(spark):
    alerts = alerts_of(spark, QUIET, NETWORK)
    assert alerts.count() == 2 and alerts.columns == ALERT.names
    network, quiet = normalize_alerts(alerts, AS_OF).orderBy(F.desc("level")).collect()
    # The first group names the event; without a log the rule's description stands in.
    assert (network.event_type, network.user, network.level, network.rule_id) == (
        "flow", "wren", 14, "fw-9")
    assert (quiet.event_type, quiet.raw_log, quiet.user) == (
        "inventory", "nightly inventory done", None)
    assert {network.status, quiet.status} == {"normalized"}
    results = run_once(alerts, 10, as_of=AS_OF).collect()
    # 14/15 of 60, a public source and an internal server; 1/15 of 60 and an internal server.
    assert [(r.severity, r.label) for r in results] == [(78, "critical"), (20, "benign")]
    assert results[1].event.source_ip == "0.0.0.0" and results[1].event.destination_ip == "10.0.0.77"


def test_empty_answers_and_files(spark, folder):
    assert alerts_of(spark).count() == 0
    assert parse_envelopes(spark.createDataFrame([("{}",)], "value string")).count() == 0
    path = folder("envelopes")
    spark.createDataFrame([(envelope(NETWORK, QUIET),), (envelope(),)], "value string").write.text(path)
    assert read_envelopes(spark, path).count() == 2
    path = folder("alerts")
    spark.createDataFrame([(json.dumps(a),) for a in (QUIET, NETWORK)], "value string").write.text(path)
    newest = newest_alerts(read_alerts(spark, path), 1).first()
    assert newest.rule.id == "fw-9"


def test_broken_alerts_fall_back(spark):
    odd = [
        {"rule": None, "data": None, "agent": None, "full_log": None},
        {"rule": {"groups": [], "level": "7"}, "data": {"dstport": "http"}, "timestamp": ""},
        {"data": {"srcip": "", "dstport": "", "srcport": "5050"}, "agent": {"ip": "9.9.9.9"},
         "full_log": "from 1.1.1.1 to 2.2.2.2", "rule": {"level": 12}},
        {"data": {"srcip": "3.3.3.3", "dstport": 0, "srcport": "1"}, "full_log": "from 1.1.1.1",
         "agent": {"ip": "9.9.9.9"}, "rule": {"level": "high"}},
    ]
    lines = [(json.dumps(dict(o, id=str(i))),) for i, o in enumerate(odd)]
    alerts = spark.read.schema(ALERT).json(spark.createDataFrame(lines, "v string").rdd.map(
        lambda r: r.v))
    normal = normalize_alerts(alerts, AS_OF, ("id",))
    a, b, c, d = normal.orderBy("id").collect()
    assert (a.source_ip, a.destination_ip, a.port, a.event_type, a.level, a.raw_log) == (
        None, None, None, "unknown", None, "")
    assert a.timestamp == "2026-06-01T00:00:00+00:00"
    assert (b.event_type, b.level, b.port, b.timestamp) == (
        "unknown", 7, None, "2026-06-01T00:00:00+00:00")
    assert (c.source_ip, c.destination_ip, c.port) == ("1.1.1.1", "2.2.2.2", None)
    assert (d.source_ip, d.destination_ip, d.port, d.level) == ("3.3.3.3", "9.9.9.9", None, None)
    ports = [(r.port, r.level) for r in fill_defaults(normal, ("id",)).orderBy("id").collect()]
    assert ports == [(0, 0), (0, 7), (5050, 12), (0, 0)]


def test_csv_reader_cases(spark, folder):
    path = folder("csv")
    text = ('log,category\n"two\nlines",a\n"say ""hi""",b\nC:\\tmp\\x,c\n,d\nshort\n'
            'more,e,extra\n\n"trailing \\",f\n')
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.option(
        "lineSep", "\x00").text(path)
    # The text sink ends the file with its separator; the reader sees one row more at most.
    rows = [(r.log, r.category) for r in read_log_csv(spark, path, multi_line=True).collect()]
    assert rows[:8] == [("two\nlines", "a"), ('say "hi"', "b"), ("C:\\tmp\\x", "c"), ("", "d"),
                        ("short", ""), ("more", "e"), ("trailing \\", "f")] + rows[7:8]


def test_csv_to_json_and_back(spark, folder):
    source, target = folder("in"), folder("out")
    logs = [("Oct  7 21:05:19 h door: entry for lee from 1.2.3.4", "auth"),
            ("a \"quoted\"\nlog, with 5.6.7.8 9.9.9.9", "web"), ("", "none")]
    spark.createDataFrame(logs, RAW_LOG).write.option("header", True).option(
        "escape", '"').csv(source)
    events = normalize_logs(read_log_csv(spark, source, multi_line=True), as_of=AS_OF)
    assert write_json(events, target) == 3 and write_json(events, target) == 3
    assert spark.read.json(target).count() == 3
    back = {r.event_type: r for r in spark.read.json(target).collect()}
    assert back["auth"].timestamp == "2026-10-07T21:05:19+00:00" and back["auth"].user == "lee"
    assert (back["web"].source_ip, back["web"].destination_ip) == ("5.6.7.8", "9.9.9.9")
    assert back["web"].raw.log == logs[1][0] and back["none"].severity == 0
    assert write_results(events.withColumn("day", F.lit("2026-06-01")), folder("day"), "day") == 3


def test_field_rows(spark):
    rows = spark.createDataFrame(
        [("t1", "", "2.2.2.2", "3.3.3.3", "4.4.4.4", "login", "bob", "hello"),
         ("", "1.1.1.1", "2.2.2.2", "", None, "", "", "")], FIELD_LOG)
    a, b = normalize_fields(rows, as_of=AS_OF).collect()
    assert (a.source_ip, a.destination_ip, a.timestamp, a.event_type) == (
        "2.2.2.2", "3.3.3.3", "t1", "login")
    assert (b.source_ip, b.destination_ip, b.timestamp, b.event_type) == ("1.1.1.1", None, "", "")
    assert a.context["source_ip"] == "2.2.2.2" and a.source == "csv_dataset" and a.severity == 0
    bare = normalize_fields(rows.select("src_ip"), "feed", AS_OF).first()
    assert (bare.event_type, bare.message, bare.user, bare.source) == ("unknown", "", None, "feed")
    assert bare.timestamp == "2026-06-01T00:00:00+00:00"
    lone = normalize_logs(spark.createDataFrame([(None,)], "log string"), as_of=AS_OF).first()
    assert (lone.event_type, lone.message) == ("unknown", "")


def test_hit_ids_and_unreadable_answers(spark):
    hits = [{"_id": "h1", "_source": QUIET}, {"_id": "h2", "_source": dict(NETWORK, id="own")}]
    answers = [(json.dumps({"hits": {"hits": hits}}),), ('{"hits": {}}',), (None,)]
    rows = parse_envelopes(spark.createDataFrame(answers, "value string")).collect()
    assert [r.id for r in rows] == ["h1", "own"]
    broken = spark.createDataFrame([("no answer",)], "value string")
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        parse_envelopes(broken).collect()


def test_row_access(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    row = df.select(field_value(df, "b").alias("b"), field_value(df, "zz").alias("z"),
                    row_json(df).alias("j")).first()
    assert (row.b, row.z, json.loads(row.j)) == ("x", None, {"a": 1, "b": "x"})
    assert df.select(pad_left(F.lit("1234"), 3)).first()[0] == "1234"


def test_json_array_over_part_files(spark, folder):
    """The parts joined by name are one document, whatever parts are empty."""
    for rows in (0, 1, 500):
        path = folder("array")
        data = spark.range(rows).selectExpr("id", "concat('say \"', id, '\"\n') as text").repartition(7)
        assert write_json_array(data, path) == rows
        parts = spark.sparkContext.wholeTextFiles(f"{path}/part-*").sortByKey().values().collect()
        read = json.loads("".join(parts))
        assert sorted(r["id"] for r in read) == list(range(rows))
        assert all(r["text"] == f'say "{r["id"]}"\n' for r in read)
