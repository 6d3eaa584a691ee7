"""Networks of both families against Python's ipaddress."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from emberwatch.functions.ipaddr import address_key
from emberwatch.operators import networks as n


def listed_by_hand(text, lines):
    if text is None:
        return False
    if text in lines:
        return True
    try:
        address = ipaddress.ip_address(text)
    except ValueError:
        return False
    nets = []
    for line in lines:
        try:
            nets.append(ipaddress.ip_network(line, strict=False))
        except ValueError:
            pass
    return any(address in net for net in nets if net.version == address.version)


def random_case():
    rng = random.Random(8)
    lines = ["not an address", "1.2.3.4/33", "2001:db8::/129", "10.1.2.3/9", "2001:DB8:0:1::7",
             "::ffff:9.9.9.0/120", "fe80::1%eth0/64", "", "8.8.8.8"]
    for _ in range(80):
        wide, kind = rng.choice([(32, ipaddress.IPv4Address), (128, ipaddress.IPv6Address)])
        low = rng.getrandbits(16) if rng.random() < 0.5 else rng.getrandbits(wide)
        lines.append(f"{kind(low)}/{rng.randrange(3 if wide == 32 else 9, wide + 1)}")
    nets = []
    for line in lines:
        try:
            nets.append(ipaddress.ip_network(line, strict=False))
        except ValueError:
            pass
    texts = [None, "", "host", "not an address", "1.2.3.4/33", "2001:db8:0:1:0:0:0:7", "08.8.8.8",
             "::ffff:9.9.9.77", "9.9.9.77", "::FFFF:909:94D", "fe80::1%eth0", "1::2::3", "8.8.8.8"]
    for net in nets:
        kind, top = type(net[0]), 2 ** net.max_prefixlen
        for number in (int(net[0]) - 1, int(net[0]), int(net[-1]), int(net[-1]) + 1):
            if 0 <= number < top:
                texts += [str(kind(number)), kind(number).exploded.upper()]
    return lines, texts


@pytest.mark.parametrize("most", [None, 0])
def test_flags_against_ipaddress(spark, most):
    lines, texts = random_case()
    entries = spark.createDataFrame([(x,) for x in lines * 2 + [None]], "entry string")
    events = spark.createDataFrame(
        [(t, listed_by_hand(t, lines)) for t in texts * 2], "source_ip string, want boolean"
    )
    found = n.checked_networks(entries, most)
    assert found.small == (most is None)
    out = n.flag_in_networks(events.repartition(5), found)
    assert out.columns == ["source_ip", "want", "listed"]
    rows = out.collect()
    assert len(rows) == 2 * len(texts) and {r.want for r in rows} == {True, False}
    assert [r for r in rows if r.want != r.listed] == []
    none = n.checked_networks(entries.limit(0), most)
    assert n.flag_in_networks(events, none).filter("listed").count() == 0
    assert n.flag_in_networks(events.limit(0), found).count() == 0


def test_keys_sort_like_numbers(spark):
    rng = random.Random(2)
    v6 = [ipaddress.IPv6Address(rng.getrandbits(128) >> rng.randrange(120)) for _ in range(300)]
    v4 = [ipaddress.IPv4Address(rng.getrandbits(32)) for _ in range(100)]
    rows = [(str(x), f"6{int(x):032x}") for x in v6] + [(x.exploded, f"6{int(x):032x}") for x in v6]
    rows += [(str(x), f"4{int(x):08x}") for x in v4]
    rows += [(x, None) for x in ("", None, ":", "1.2.3", "1.2.3.256", "::g", "1:2:3:4:5:6:7:8:9")]
    got = spark.createDataFrame(rows, "ip string, want string").withColumn("key", address_key(F.col("ip")))
    assert got.filter("not (key <=> want)").collect() == []


def test_merged_intervals_cover_the_same_keys(spark):
    """One interval over a third of the others, chains of overlaps, copies, many slices."""
    rng = random.Random(5)
    spans = [(x, x + rng.randrange(12)) for x in (rng.randrange(20_000) for _ in range(3000))]
    spans += [(5000, 12_000), (0, 0)]
    text = [(f"6{a:032x}", f"6{b:032x}") for a, b in spans * 2]
    got = sorted((int(r.low[1:], 16), int(r.high[1:], 16)) for r in n.disjoint(
        spark.createDataFrame(text, "low string, high string").repartition(16)).collect())
    covered = {k for a, b in spans for k in range(a, b + 1)}
    assert {k for a, b in got for k in range(a, b + 1)} == covered
    assert all(b < c for (_, b), (c, _) in zip(got, got[1:]))
    assert n.disjoint(spark.createDataFrame([], "low string, high string")).count() == 0


def test_zones_of_entries_do_not_count(spark):
    lines = ["fe80::1%eth0/64", "2001:db8::7%1.2.3.4", "10.0.0.0%eth0/8", "fc00::%/8", "fd00::1%a%b/8",
             "fd00::1%a/b/8", "11.0.0.0%a:b/8"]
    texts = ["fe80::2", "fe80::3%eth1", "fe80:0:0:1::", "2001:db8::7", "2001:db8::8", "2001:db8::102:304",
             "10.0.0.1", "11.0.0.1", "fc00::1", "fd00::1", "fd00::1%a%b/8", "fc00::%/8"]
    found = n.checked_networks(spark.createDataFrame([(x,) for x in lines], "entry string"))
    events = spark.createDataFrame([(x, listed_by_hand(x, lines)) for x in texts],
                                   "source_ip string, want boolean")
    rows = n.flag_in_networks(events, found).collect()
    assert {r.source_ip for r in rows if r.listed} == {r.source_ip for r in rows if r.want}
    assert {"fe80::2", "fe80::3%eth1", "2001:db8::7"} <= {r.source_ip for r in rows if r.listed}
