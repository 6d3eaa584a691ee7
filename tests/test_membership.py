import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from emberwatch.operators import membership as m
from emberwatch.plans import tables
from emberwatch.operators.normalize import normalize_alerts
from emberwatch.sources.blocklist import clean_blocklist, read_blocklist

LINES = ["# comment", "", " 45.33.46.90 ", "192.168.1.9", "10.0.0.122", "198.51.100.8",
         "198.51.100.8", "45.33.64.0/18", "8.8.4.0/24"]


def entries(spark, lines):
    return clean_blocklist(spark.createDataFrame([(x,) for x in lines], "value string"))


def test_cleaning(spark, folder):
    path = folder("list")
    spark.createDataFrame([(x,) for x in LINES + ["   "]], "value string").write.text(path)
    seen = {r.entry for r in read_blocklist(spark, path).collect()}
    assert seen == {"45.33.46.90", "192.168.1.9", "10.0.0.122", "198.51.100.8", "45.33.64.0/18",
                    "8.8.4.0/24", ""}


@pytest.mark.parametrize("small", [True, False])
def test_fixture_counts(spark, small):
    """Fixture counts at sf0.01: 219 exact hits, 1,276 with ranges, nulls never."""
    events = normalize_alerts(tables.alerts(spark, "/root/testdata/sf0.01"), keep=("alert_id",))
    events = events.select("alert_id", "source_ip")
    exact = m.Lookup(entries(spark, LINES), small)
    ranged = m.Lookup(m.expand_ranges(entries(spark, LINES)), small)
    flagged = m.flag_listed(events, exact)
    assert flagged.count() == 10_000
    assert flagged.filter("listed").count() == 219
    assert m.flag_in_ranges(events, ranged).filter("listed").count() == 1276
    assert m.only_listed(events, exact).count() == 219
    assert m.only_unlisted(events, exact).count() == 9_781


@pytest.mark.parametrize("small", [True, False])
def test_ranges_against_brute_force(spark, small):
    rng = random.Random(3)
    lines = ["not an address", "10", "10.0.*", "1.2.3.4/33", "2001:db8::1", "0.0.0.0/6"]
    for _ in range(60):
        bits = rng.randrange(5, 33)
        net = ipaddress.ip_network((rng.getrandbits(32) >> (32 - bits) << (32 - bits), bits))
        lines.append(str(net))
    nets = [ipaddress.ip_network(x) for x in lines[5:]]
    texts = ["10", "10.0.*", "not an address", "2001:db8::1", "01.2.3.4", None, "10.9.9.9"]
    for net in nets:
        for number in (int(net[0]) - 1, int(net[0]), int(net[-1]), int(net[-1]) + 1):
            if 0 <= number < 2**32:
                texts.append(str(ipaddress.IPv4Address(number)))
    texts += [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(300)]

    def listed(text):
        if text in lines:
            return True
        try:
            return any(ipaddress.IPv4Address(text) in net for net in nets)
        except ValueError:
            return False

    events = spark.createDataFrame([(t, listed(t)) for t in texts], "source_ip string, want boolean")
    ranges = m.Lookup(m.expand_ranges(entries(spark, lines)), small)
    out = m.flag_in_ranges(events, ranges)
    assert out.count() == len(texts)
    assert out.filter("listed <> want").collect() == []


def test_size_check_decides(spark):
    few = entries(spark, LINES)
    assert m.checked(few).small
    assert not m.checked(few, max_rows=3).small
    assert not m.checked(few, max_bytes=10).small


def test_hot_addresses_are_spread(spark, monkeypatch):
    """Neither list nor hits may be broadcast; a third of the rows share one address, a third
    have none, and copies are identical. Every row keeps its verdict and no task gets the lot."""
    monkeypatch.setattr(m, "BROADCAST_ROWS", 100)
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        ip = """case id % 3 when 0 then '9.9.9.9' when 1 then null
                else concat('8.8.', id % 199, '.', id % 251) end"""
        events = spark.range(0, 60_000, 1, 32).selectExpr(f"{ip} as source_ip")
        listed = spark.range(3000).selectExpr("concat('8.8.', id % 199, '.', id % 251) as entry")
        listed = listed.union(spark.createDataFrame([("9.9.9.9",)], "entry string")).distinct()
        out = m.flag_listed(events, m.checked(listed))
        assert "SortMergeJoin" in out._jdf.queryExecution().executedPlan().toString()
        slices = out.groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in slices) == 60_000
        assert max(r["count"] for r in slices) < 15_000
        assert out.filter("source_ip = '9.9.9.9' and listed").count() == 20_000
        assert out.filter("source_ip is null and not listed").count() == 20_000
        rest = out.filter("source_ip like '8.8.%'")
        want = rest.join(listed, F.col("source_ip") == F.col("entry"), "left_semi").count()
        assert 0 < want < 20_000 and rest.filter("listed").count() == want
        assert m.only_listed(events, m.checked(listed)).count() == 20_000 + want
        assert m.only_unlisted(events, m.checked(listed)).count() == 40_000 - want
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
