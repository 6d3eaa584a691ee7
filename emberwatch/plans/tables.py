"""Security records derived from the given tables by fixed projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flat_alerts(events: DataFrame) -> DataFrame:
    """One alert per row of ``events``: the flat form of the fixture view."""
    based = events.selectExpr(
        "event_id", "ts", "user_id", "event_type",
        "cast(get_json_object(props, '$.k') as bigint) as k",
    )
    parts = based.selectExpr(
        "*",
        "cast((event_id * 7) % 16 as int) as level",
        """case user_id % 4
             when 0 then concat('192.168.1.', cast(user_id % 250 + 1 as string))
             when 1 then concat('10.0.0.', cast(user_id % 250 + 1 as string))
             when 2 then concat('45.33.', cast(user_id % 200 as string), '.', cast(k + 1 as string))
             else concat('198.51.100.', cast(user_id % 250 + 1 as string)) end as src""",
        """case k % 5 when 0 then null
             when 1 then concat('10.0.0.', cast(k + 1 as string))
             when 2 then concat('192.168.1.1', cast(k % 10 as string))
             when 3 then '172.16.0.10'
             else concat('8.8.4.', cast(k + 1 as string)) end as dst""",
        """case k % 8 when 0 then '22' when 1 then '80' when 2 then '90' when 3 then '443'
             when 4 then '3306' when 5 then '8080' when 6 then '0' else null end as dstport""",
        "concat('u', cast(user_id as string)) as u",
    )
    to = "case when dst is null then '' else concat('{0}', dst) end"
    return parts.selectExpr(
        "event_id as alert_id", "ts", "level", "concat('r', cast(level as string)) as rule_id",
        "event_type", "case when k % 3 = 0 then src else null end as srcip", "dstport",
        "case when k % 7 = 0 then '10.0.0.9' else null end as agent_ip",
        f"""case event_type
          when 'error' then concat(date_format(ts, 'MMM dd HH:mm:ss'),
            ' host sshd[1]: Failed password for ', u, ' from ', src, ' port 22 ssh2',
            {to.format(' to ')})
          when 'signup' then concat('date=', date_format(ts, 'yyyy-MM-dd'),
            ' time=', date_format(ts, 'HH:mm:ss'), ' account=', u, ' srcip=', src,
            {to.format(' dstip=')})
          when 'purchase' then concat(date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
            ' session opened for user ', u, ' by (uid=0) from ', src, {to.format(' to ')})
          when 'view' then concat('[', date_format(ts, 'dd/MMM/yyyy:HH:mm:ss'), ' ] [client ', src,
            '] user ', u, ': GET /x')
          else case when k % 10 = 0 then '' else concat('At ', date_format(ts, 'HH:mm:ss'), ' ',
            date_format(ts, 'dd/MM/yyyy'), ' (', u, '@host) ', src, {to.format(' -> ')}) end
          end as full_log""",
    )


def nest_alerts(flat: DataFrame) -> DataFrame:
    """The flat view as nested alert records, with its number and instant alongside."""
    return flat.select(
        "alert_id",
        "ts",
        F.col("alert_id").cast("string").alias("id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'+0000'").alias("timestamp"),
        F.struct(
            F.col("level").cast("string").alias("level"),
            F.col("rule_id").alias("id"),
            F.concat(F.lit("Rule "), F.col("rule_id")).alias("description"),
            F.array("event_type").alias("groups"),
        ).alias("rule"),
        F.struct(
            F.col("srcip"), F.col("dstport"), F.lit("5000").alias("srcport"),
        ).alias("data"),
        F.struct(F.col("agent_ip").alias("ip")).alias("agent"),
        "full_log",
    )


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nest_alerts(flat_alerts(table(spark, sf_dir, "events")))


# One line per time and user shape, with the misses and the traps between them.
_LOG_FORMS = [
    """concat(date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), '.5Z account=', u, ' x')""",
    "concat('date=', date_format(ts, 'yyyy-MM-dd'), '  time=', date_format(ts, 'HH:mm:ss'), ' hi')",
    "concat(date_format(ts, 'MMM  d HH:mm:ss'), ' h door: entry for ', u, ' from ', a)",
    """concat('[', date_format(ts, 'EEE MMM dd HH:mm:ss'), ' 1996] [client ', a, '] user ', u,
       ': x')""",
    "concat('[Thu Feb 29 ', date_format(ts, 'HH:mm:ss'), ' 1996] x')",
    "concat('[', lower(date_format(ts, 'EEE MMM dd HH:mm:ss')), ' 1996] x')",
    "concat('Feb 29 ', date_format(ts, 'HH:mm:ss'), ' x')",
    "concat('[Time ', date_format(ts, 'yyyy.MM.dd HH:mm:ss'), ' +02] x')",
    "concat(date_format(ts, 'HH:mm:ss'), ' x ', a, ' ', b)",
    "concat('NOTE ', date_format(ts, 'yyyy-MM-dd HH:mm:ss'), ' (', u, '@h1)')",
    """concat('At ', date_format(ts, 'HH:mm:ss'), ' ', date_format(ts, 'dd/MM/yyyy'), ' user ', u,
       ' "quoted, text"')""",
    "concat('[', date_format(ts, 'dd/MMM/yyyy:HH:mm:ss'), ' ] ', a, ' ', b, ' 7.7.7.7')",
    "'session closed for user omar by (uid=7)'",
    "concat('1900-', date_format(ts, 'MM-dd'), 'T', date_format(ts, 'HH:mm:ss'), ' x')",
    "'nothing here'",
    "''",
    "null",
    "concat('2024-13-45T25:61:61 then ', date_format(ts, 'yyyy-MM-dd HH:mm:ss'), ' 1.2.3.4567')",
    "concat('by (uid=0) grants user -', u)",
    "concat('0000-01-01T00:00:00 x ', date_format(ts, 'HH:mm:ss'), '\\nsession opened for user ', u)",
]


def raw_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw log line per row of ``events``: ``seq``, ``log``, ``category``."""
    based = table(spark, sf_dir, "events").selectExpr(
        "event_id", "ts", "event_type", "concat('u', cast(user_id as string)) as u",
        "concat('45.33.', cast(user_id % 200 as string), '.', cast(event_id % 250 as string)) as a",
        "concat('10.0.0.', cast(event_id % 300 as string)) as b",
    )
    forms = " ".join(f"when {i} then {form}" for i, form in enumerate(_LOG_FORMS))
    return based.selectExpr(
        "event_id as seq",
        f"case event_id % {len(_LOG_FORMS)} {forms} end as log",
        "case when event_id % 17 = 0 then null else event_type end as category",
    )


def field_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with field columns, some of them empty."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id as seq",
        "date_format(ts, 'yyyy-MM-dd HH:mm:ss') as timestamp",
        "case when event_id % 3 = 0 then '' else concat('10.0.0.', cast(user_id as string)) end"
        " as src_ip",
        "concat('45.33.1.', cast(event_id % 250 as string)) as source_ip",
        "case when event_id % 5 = 0 then null else concat('10.0.1.', cast(user_id as string)) end"
        " as dst_ip",
        "case when event_id % 2 = 0 then null else '8.8.8.8' end as destination_ip",
        "event_type",
        "concat('u', cast(user_id as string)) as user",
        "props as message",
    )


def blocklist_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One block-list line per customer: addresses, ranges, comments, blanks and duplicates."""
    return table(spark, sf_dir, "customer").selectExpr(
        """case c_custkey % 7
             when 0 then concat('# customer ', cast(c_custkey as string))
             when 1 then ''
             when 2 then concat(' 45.33.', cast(c_custkey % 200 as string), '.',
                                cast(c_custkey % 99 as string), ' ')
             when 3 then concat('192.168.1.', cast(c_custkey % 120 as string))
             when 4 then concat('45.33.', cast(c_custkey % 250 div 64 * 64 as string), '.0/18')
             when 5 then concat('198.51.100.', cast(c_custkey % 250 div 16 * 16 as string), '/28')
             else concat('8.8.', cast(c_custkey % 50 as string), '.0/24') end as value"""
    )


def dashboard_alerts(scored: DataFrame) -> DataFrame:
    """Scored events in dashboard shape; severity words come from the display bands."""
    from emberwatch.functions.scoring import band_of

    return scored.select(
        F.concat(F.lit("EVT-"), F.col("alert_id").cast("string")).alias("id"),
        "timestamp", "event_type", "source_ip", "user",
        band_of(F.col("severity")).alias("severity"),
        F.col("severity").alias("score"),
        F.expr("case alert_id % 3 when 0 then 'open' when 1 then 'review' else 'closed' end")
        .alias("status"),
        F.col("raw_log").alias("message"),
        "ts",
    )


def spread_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dotted text per row of ``events``, over the whole space and around every range edge."""
    based = table(spark, sf_dir, "events").selectExpr(
        "event_id", "cast(event_id % 256 as string) as lo",
        "cast(event_id * 31 % 256 as string) as mid", "cast(event_id * 131 % 256 as string) as hi",
    )
    return based.selectExpr(
        "event_id",
        """case event_id % 16
             when 0 then concat(hi, '.', mid, '.', lo, '.', mid)
             when 1 then concat('172.', mid, '.0.', lo)
             when 2 then concat('192.0.0.', cast(event_id div 16 % 20 as string))
             when 3 then concat('198.', mid, '.100.', lo)
             when 4 then concat('100.', mid, '.', lo, '.1')
             when 5 then concat('192.', hi, '.2.', lo)
             when 6 then concat('10.0.0.', cast(event_id % 400 as string))
             when 7 then concat('0', lo, '.2.3.4')
             when 8 then concat(cast(event_id % 400 as string), '.1.1.1')
             when 9 then concat('203.0.', mid, '.', lo)
             when 10 then concat('169.', hi, '.', lo, '.9')
             when 11 then concat('192.168.1.', lo)
             when 12 then concat(' 10.0.0.', lo)
             when 13 then null
             when 14 then concat('198.51.', mid, '.', lo)
             else concat(hi, '.168.', mid, '.', lo) end as ip""",
    )


# Colon spellings; {0} and {1} stand for one and four hex digits taken from the row.
COLON_FORMS = [
    "2001:db8::{1}", "fe80::{1}:1", "FD00:{1}::1", "2606:4700::{1}", "::1", "::",
    "::ffff:10.0.0.{0}", "::ffff:8.8.8.{0}", "2001:0:{1}::2", "2001:20::{1}", "2001:1::1",
    "64:ff9b:1:{1}::", "100::{1}", "2002:{1}::", "1:2:3:4:5:6:7:{1}", "1:2:3:4:5:6:7:8:{1}",
    "fe80::{1}%eth0", "fec0::{1}", "12345::{1}", "2001:4:112::{1}", "2001:db8::{1}::1",
    "1:2:3:4:5:6:7::{1}", "2001:3:{1}::", "::10.0.0.{0}",
]


def colon_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One colon text per row of ``events``."""
    def spelled(form: str) -> str:
        text = form.replace("{0}", "', cast(event_id % 10 as string), '")
        text = text.replace("{1}", "', lower(hex(event_id % 65000 + 256)), '")
        return f"concat('{text}')"

    forms = " ".join(f"when {i} then {spelled(form)}" for i, form in enumerate(COLON_FORMS))
    return table(spark, sf_dir, "events").selectExpr(
        "event_id", f"case event_id % {len(COLON_FORMS)} {forms} end as ip"
    )


def mixed_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An address per event: dotted, or colon text in one of three spellings."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id",
        """case event_id % 5
             when 0 then concat_ws('.', '45', '33', user_id * 13 % 256, event_id % 256)
             when 1 then concat('2001:db8:', lower(hex(user_id * 13 % 4096)), '::',
               lower(hex(event_id % 65536)))
             when 2 then concat('2001:0DB8:', hex(user_id * 13 % 4096), ':0:0:0:0:',
               hex(event_id % 65536))
             when 3 then concat('2001:db8:', lower(hex(user_id * 13 % 4096)), '::0.0.',
               cast(event_id % 65536 div 256 as string), '.', cast(event_id % 256 as string))
             when 4 then if(event_id % 2 = 0, null, 'host') end as ip""",
    )


def networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping networks of both families, from the customers and suppliers."""
    wide = table(spark, sf_dir, "customer").filter("c_custkey % 11 = 0").selectExpr(
        "concat('2001:db8:', lower(hex(c_custkey * 7 % 4096)), '::/', "
        "cast(42 + c_custkey % 7 as string)) as entry"
    )
    suppliers = table(spark, sf_dir, "supplier")
    narrow = suppliers.selectExpr(
        "concat('2001:db8:', hex(s_suppkey * 13 % 4096), '::', hex(s_suppkey * 37 % 65536), '/', "
        "cast(113 + s_suppkey % 16 as string)) as entry"
    )
    dotted = suppliers.filter("s_suppkey % 3 = 0").selectExpr(
        "concat_ws('.', '45', '33', s_suppkey * 29 % 256, s_suppkey * 5 % 256) as host", "s_suppkey"
    ).selectExpr("if(s_suppkey % 2 = 0, host, concat(host, '/', 21 + s_suppkey % 12)) as entry")
    return wide.unionByName(narrow).unionByName(dotted).distinct()
