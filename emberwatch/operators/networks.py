"""Addresses in networks of either family, by disjoint intervals of sortable keys."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.functions.ipaddr import address_key
from emberwatch.operators import membership
from emberwatch.session import scratch_path

# 33 characters a bound, so at most 15 MB are broadcast.
BROADCAST_INTERVALS = 200_000
BITS = r"/(0|[1-9][0-9]{0,2})\z"
# The zone of a colon address, which does not count; dotted ones have none.
ZONE = r"\A([^%]*:[^%]*)%[^%/]+\z"


@dataclass(frozen=True)
class Networks:
    """Disjoint intervals, the verdict of their size check, and entries that are no address."""

    intervals: DataFrame
    small: bool
    texts: membership.Lookup


def _parsed(entries: DataFrame) -> DataFrame:
    """Stored entries with the key of their address, null where they are no network, and its length."""
    entry = F.col("entry")
    host = F.regexp_replace(F.regexp_replace(entry, BITS, ""), ZONE, "$1")
    rows = _stored(entries.select(
        "entry", address_key(host).alias("key"), F.regexp_extract("entry", BITS, 1).alias("n")
    ), "list")
    width = (F.length("key") - 1) * 4
    bits = F.when(F.col("n") == "", width).otherwise(F.col("n").try_cast("int"))
    return rows.select("entry", F.when(bits <= width, F.col("key")).alias("key"), bits.alias("bits"))


def intervals(entries: DataFrame) -> DataFrame:
    """First and last key of every address or network among the entries; host bits are ignored."""
    return _bounds(_parsed(entries))


def _bounds(parsed: DataFrame) -> DataFrame:
    rows = parsed.filter("key is not null")
    # The digit that the length parts; there is none if it ends at the last one.
    whole = F.floor(F.col("bits") / 4).cast("int")
    digit = F.coalesce(
        F.conv(F.substring("key", whole + 2, F.lit(1)), 16, 10).try_cast("int"), F.lit(0)
    )
    unit = F.expr("shiftleft(1, 4 - bits % 4)")
    first = digit - digit % unit
    head, size = F.substring("key", F.lit(1), whole + 1), F.length("key")

    def bound(number: Column, fill: str) -> Column:
        return F.rpad(F.concat(head, F.lower(F.hex(number))), size, F.lit(fill))

    return rows.select(
        bound(first, "0").alias("low"), bound(first + unit - 1, "f").alias("high")
    ).distinct()


def _stored(rows: DataFrame, name: str) -> DataFrame:
    path = scratch_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _ranged(rows: DataFrame, *order: str) -> DataFrame:
    """The rows stored in slices of ascending order, numbered in ``slice``."""
    parted = rows.repartitionByRange(*order).withColumn("slice", F.spark_partition_id())
    return _stored(parted, "address-slices")


def _before(totals: DataFrame, value: Column) -> DataFrame:
    """``value`` over all slices before each; there is one row per slice."""
    earlier = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(totals.select("slice", value.over(earlier).alias("_carried")))


def disjoint(spans: DataFrame) -> DataFrame:
    """Overlapping intervals merged; ones that only touch stay apart.

    Rows are sorted in slices. What reaches into a slice from those before it is one value, so a
    long interval over all others is found without gathering them.
    """
    rows = _ranged(spans, "low", "high")
    here = Window.partitionBy("slice").orderBy("low", "high")
    ends = rows.groupBy("slice").agg(F.max("high").alias("high"))
    reach = F.greatest(
        F.max("high").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.col("_carried")
    )
    rows = rows.join(_before(ends, F.max("high")), "slice", "left").select(
        "slice", "low", "high", F.coalesce((F.col("low") > reach).cast("long"), F.lit(1))
        .alias("first"),
    )
    rows = _stored(rows, "address-islands")
    firsts = rows.groupBy("slice").agg(F.sum("first").alias("first"))
    island = F.sum("first").over(here.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(
        F.col("_carried"), F.lit(0)
    )
    return rows.join(_before(firsts, F.sum("first")), "slice", "left").select(
        island.alias("island"), "low", "high"
    ).groupBy("island").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("island")


def checked_networks(entries: DataFrame, max_rows: int | None = None) -> Networks:
    """Merge and store the list once and count it; only a bounded one is ever broadcast."""
    parsed = _parsed(entries)
    spans = _stored(disjoint(_bounds(parsed)), "networks")
    texts = parsed.filter("key is null and entry is not null").select("entry").distinct()
    bound = BROADCAST_INTERVALS if max_rows is None else max_rows
    return Networks(spans, spans.count() <= bound, membership.checked(texts))


def flag_in_networks(
    events: DataFrame, listed: Networks, ip: str = "source_ip", flag: str = "listed"
) -> DataFrame:
    """Add a boolean: is the address in a network of the list, or the text an entry of it?

    Few intervals are searched by halving in every task. With many, the distinct addresses are sorted
    among them in slices, each compared with the interval that starts last before it, and those
    found then act as an exact list. Null never is listed.
    """
    keyed = events.withColumn("_key", address_key(F.col(ip)))
    if listed.small:
        hit = keyed.withColumn("_hit", _search(listed.intervals)(F.col("_key")))
    else:
        keyed = _stored(keyed, "events")
        found = _swept(keyed.select("_key").filter("_key is not null").distinct(), listed.intervals)
        hit = membership.flag_listed(keyed, membership.checked(found), "_key", "_hit")
    hit = membership.flag_listed(hit, listed.texts, ip, "_text")
    return hit.withColumn(flag, F.col("_hit") | F.col("_text")).drop("_key", "_hit", "_text")


def _search(spans: DataFrame):
    rows = spans.orderBy("low").toPandas()
    bounds = spans.sparkSession.sparkContext.broadcast(
        (rows["low"].to_numpy("S33"), rows["high"].to_numpy("S33"))
    )

    @F.pandas_udf("boolean")
    def inside(keys: pd.Series) -> pd.Series:
        low, high = bounds.value
        known = keys.notna().to_numpy()
        values = keys[known].to_numpy("S33")
        at = np.searchsorted(low, values, "right") - 1
        result = np.zeros(len(keys), bool)
        if len(low):
            result[known] = (at >= 0) & (values <= high[at])
        return pd.Series(result)

    return inside


def _swept(keys: DataFrame, spans: DataFrame) -> DataFrame:
    """The distinct keys that lie in one of the disjoint intervals, as ``entry``."""
    marks = spans.select(F.col("low").alias("key"), F.lit(0).alias("asked"), "high")
    asked = keys.select(F.col("_key").alias("key"), F.lit(1).alias("asked"),
                        F.lit(None).cast("string").alias("high"))
    rows = _ranged(marks.unionByName(asked), "key", "asked")
    ends = rows.groupBy("slice").agg(F.max("high").alias("high"))
    here = Window.partitionBy("slice").orderBy("key", "asked").rowsBetween(
        Window.unboundedPreceding, 0
    )
    # Intervals are disjoint, so the greatest end so far is that of the last one.
    reach = F.greatest(F.max("high").over(here), F.col("_carried"))
    return rows.join(_before(ends, F.max("high")), "slice", "left").select(
        F.col("key").alias("entry"), "asked", reach.alias("reach")
    ).filter("asked = 1 and entry <= reach").select("entry")
