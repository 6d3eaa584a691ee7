import ipaddress
import random

from pyspark.sql import functions as F

from emberwatch.functions import ipaddr


def expected(text):
    try:
        return ipaddress.ip_address(text).is_private
    except ValueError:
        return False


def _edges(cidr):
    net = ipaddress.ip_network(cidr)
    low, high = int(net.network_address), int(net.broadcast_address)
    return [n for n in (low - 1, low, high, high + 1) if 0 <= n < 2 ** net.max_prefixlen]


def _spellings(number, rng):
    address = ipaddress.IPv6Address(number)
    groups = [f"{number >> (16 * (7 - i)) & 0xFFFF:04x}" for i in range(8)]
    dotted = str(ipaddress.IPv4Address(number & 0xFFFFFFFF))
    gap = rng.randrange(8)
    thin = [g.lstrip("0") or "0" for g in groups]
    gapped = ":".join(thin[:gap]) + "::" + ":".join(thin[gap + 1:])
    return [
        str(address), ":".join(groups).upper(), f"{address}%eth0",
        ":".join(groups[:6]) + ":" + dotted, gapped if thin[gap] == "0" else str(address),
    ]


def test_classes_agree_with_the_standard_library(spark):
    rng = random.Random(7)
    texts = ["", "::", ":::", "1::2::3", "01.2.3.4", "999.1.1.1", "1.2.3", "1.2.3.4\n", " 10.0.0.1",
             "10.0.0.1 ", "10.0.0.300", "::ffff:1.2.3.400", "1.2.3.4::", "fe80::1%", "fe80::1%a%b",
             "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4::5:6:7:8", "::10.0.0.1", "::0.0.0.1"]
    for cidr in ipaddr.PRIVATE_V4 + ipaddr.PUBLIC_HOLES_V4 + ["100.64.0.0/10", "224.0.0.0/4"]:
        for number in _edges(cidr):
            texts.append(str(ipaddress.IPv4Address(number)))
            texts += _spellings((0xFFFF << 32) | number, rng)
    numbers = [n for c in ipaddr.PRIVATE_V6 + ipaddr.PUBLIC_HOLES_V6 for n in _edges(c)]
    numbers += [rng.getrandbits(128) for _ in range(50)]
    numbers += [rng.getrandbits(16) << (16 * rng.randrange(8)) for _ in range(100)]
    texts += [t for n in numbers for t in _spellings(n, rng)]
    for _ in range(1500):
        damaged = list(rng.choice(texts))
        damaged.insert(rng.randrange(len(damaged) + 1), rng.choice("0f:.%/ g"))
        texts.append("".join(damaged))
    df = spark.createDataFrame([(t, expected(t)) for t in texts], "ip string, want boolean")
    wrong = df.filter(ipaddr.is_private(F.col("ip")) != F.col("want")).collect()
    assert wrong == []
    assert df.filter("want").count() > 200


def test_null_and_internal_prefixes(spark):
    texts = [None, "10.0.0.1", "10.0.0.300", "10.0.01", "192.168.1.1", "192.168.1.100",
             "192.168.1.19", "192.168.1.2"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, ip string")
    rows = df.select("i", ipaddr.is_private(F.col("ip")).alias("p"),
                     ipaddr.is_internal_server(F.col("ip")).alias("s")).orderBy("i").collect()
    assert [r.p for r in rows] == [False, True, False, False, True, True, True, True]
    assert [r.s for r in rows] == [False, True, True, False, True, True, True, False]
