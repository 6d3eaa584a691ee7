from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from emberwatch.functions.extract import (
    addresses, clock, nth_address, parse_instant, parse_timestamp, parse_user,
)

AS_OF = "2026-06-01T00:00:00Z"
DEFAULT = "2026-06-01T00:00:00+00:00"

# (log, time as ISO without the offset or None for the default, user, addresses)
GOLDEN = [
    ("2019-02-11T08:15:42.5Z account=kim x", "2019-02-11T08:15:42", "kim", []),
    ("date=1994-11-03 time=16:20:08 hi", "1994-11-03T16:20:08", None, []),
    ("Oct  7 21:05:19 h door: entry for lee from 1.2.3.4",
     "2026-10-07T21:05:19", "lee", ["1.2.3.4"]),
    ("[Tue Nov 12 09:31:44 1996] [client 9.9.9.9] user ann: x",
     "2026-11-12T09:31:44", "ann", ["9.9.9.9"]),
    ("[Thu Feb 29 09:31:44 1996] x", "1996-02-29T09:31:44", None, []),
    ("[tue nov 12 09:31:44 1996] x", "1996-11-12T09:31:44", None, []),
    ("Feb 29 01:02:03 x", None, None, []),
    ("[Time 2003.09.21 13:02:55 +02] x", "2003-09-21T13:02:55", None, []),
    ("14:08:27 x", "2026-01-01T14:08:27", None, []),
    ("NOTE 2022-03-19 18:41:13 (bob@h1)", "2022-03-19T18:41:13", "bob@h1", []),
    ("At 11:17:36 05/10/1997 user zed", "1997-10-05T11:17:36", "zed", []),
    ("[30/Jan/1985:06:07:08 ] 1.2.3.4 5.6.7.8 7.7.7.7", "1985-01-30T06:07:08", None,
     ["1.2.3.4", "5.6.7.8", "7.7.7.7"]),
    ("session closed for user omar by (uid=7)", None, "omar", []),
    ("1900-05-05T00:00:00 x", "2026-05-05T00:00:00", None, []),
    ("nothing here", None, None, []),
    ("", None, None, []),
    # A shape that matches but is no date leaves the row to the next shape.
    ("2024-13-01T00:00:00 and 2022-03-19 18:41:13", "2022-03-19T18:41:13", None, []),
    ("2024-02-30 01:02:03", None, None, []),
    ("2024-01-01T23:59:60", None, None, []),
    ("2024-01-01T24:00:00", None, None, []),
    ("0000-01-01T00:00:00", None, None, []),
    ("1900-02-29T00:00:00", None, None, []),
    ("1900-01-01 01:02:03", "2026-01-01T01:02:03", None, []),
    ("At 01:02:03 05/06/1900", "1900-06-05T01:02:03", None, []),
    ("date=1900-06-05 time=01:02:03", "1900-06-05T01:02:03", None, []),
    # Only the first occurrence of a shape is tried.
    ("2024-99-01T00:00:00 2024-01-01T00:00:00", None, None, []),
    ("Jan 5 1:02:03", None, None, []),
    ("x 14:08:27 x", None, None, []),
    ("[xyz 17 02:47:06 1992]", None, None, []),
    ("[012 17 02:47:06 1992]", None, None, []),
    ("Jan\t 05\n10:00:00", "2026-01-05T10:00:00", None, []),
    ("Sep 31 10:00:00 [Wed Sep 30 10:00:00 1998]", "1998-09-30T10:00:00", None, []),
    # Users.
    ("account=a.b,c next account=z", None, "a.b,c", []),
    ("for user x! account=y", None, "y", []),
    ("session opened for user root(uid=0)", None, "root(uid=0)", []),
    ("Failed password for bob from  9 x", None, "bob", []),
    ("Failed password for bob from host", None, None, []),
    ("[a] user kim: y", None, "kim", []),
    ("superuser kim", None, "kim", []),
    ("(a@b@c) (d@e)", None, "a@b@c", []),
    ("(@b) (a@) (d@e)", None, "d@e", []),
    ("(no at) tail@x", None, None, []),
    ("by (uid=0) grants user -x", None, "-x", []),
    ("by (uid=0)\n grants user -x", None, None, []),
    ("for user josé\u00a0x", None, "josé", []),
    ("user žofie1 logs in", None, "žofie1", []),
    # Addresses.
    ("999.1.1.1 and 1.2.3.4567 and 1.2.3.4.5", None, None, ["999.1.1.1", "1.2.3.4"]),
    ("v1.2.3.4 é1.2.3.4 _1.2.3.4 -1.2.3.4-", None, None, ["1.2.3.4"]),
    ("1234.1.1.1", None, None, []),
]


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(i, log) for i, (log, *_) in enumerate(GOLDEN)]
    log = F.col("log")
    found = spark.createDataFrame(rows, "i int, log string").select(
        "i", parse_timestamp(log, clock(AS_OF)).alias("at"), parse_user(log).alias("user"),
        addresses(log).alias("found"), nth_address(addresses(log), 1).alias("second"),
    )
    return {row.i: row for row in found.collect()}


@pytest.mark.parametrize("i", range(len(GOLDEN)), ids=lambda i: GOLDEN[i][0][:40])
def test_golden(parsed, i):
    log, at, user, found = GOLDEN[i]
    row = parsed[i]
    assert row["at"] == (f"{at}+00:00" if at else DEFAULT)
    assert row["user"] == user
    if "v1.2.3.4" not in log:
        assert row["found"] == found
    assert row["second"] == (row["found"][1] if len(row["found"]) > 1 else None)


def test_unicode_boundaries_of_addresses(parsed):
    i = next(i for i, g in enumerate(GOLDEN) if g[0].startswith("v1.2.3.4"))
    assert parsed[i]["found"] == ["1.2.3.4"]


def test_times_ignore_the_session_zone(spark):
    """A wall time that a zone skips is still the written time."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([("2024-03-10 02:30:00",)], "log string")
        row = df.select(parse_timestamp(F.col("log"), clock(AS_OF)).alias("at")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert row["at"] == "2024-03-10T02:30:00+00:00"


def test_running_clock_and_null_log(spark):
    df = spark.createDataFrame([(None,)], "log string")
    row = df.select(
        parse_timestamp(F.col("log"), clock()).alias("at"), parse_user(F.col("log")).alias("user")
    ).first()
    assert len(row["at"]) == 32 and row["at"].endswith("+00:00") and row["user"] is None


def test_instants(spark):
    texts = ["2031-07-09T05:06:07.250+0000", "2031-07-09T07:06:07.250+02:00", "soon"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    seen = [r[0] for r in df.select(
        F.unix_millis(parse_instant(F.col("t")))).collect()]
    assert seen == [1941339967250, 1941339967250, None]


def test_without_a_given_moment_the_query_start_stands_in(spark):
    """In UTC whatever the session zone; a time without a year takes the current one."""
    before = datetime.now(timezone.utc)
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        rows = spark.createDataFrame([("nothing here",), ("Oct  7 21:05:19 h",)], "log string")
        none, yearless = [r[0] for r in rows.select(parse_timestamp(F.col("log"), clock())).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    after = datetime.now(timezone.utc)
    assert before <= datetime.fromisoformat(none) <= after and none.endswith("+00:00")
    assert yearless in {f"{t.year}-10-07T21:05:19+00:00" for t in (before, after)}
