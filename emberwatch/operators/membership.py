"""Block-list membership: exact text, and CIDR containment as an equi-join on prefixes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.ipaddr import DOTTED, is_ipv4
from emberwatch.session import checkpointed, scratch_path

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 1024 * 1024

# An address with at least one in this many rows is hot, so no more than this many are.
HOT_SHARE = 1000

# Ranges are written out at whole-octet lengths, so an address needs only these four lookups.
OCTETS = (1, 2, 3, 4)
# How prefixes of one or two octets are spelled: the numbers and a final star.
SHORT_PREFIX = r"\A(0|[1-9][0-9]{0,2})(\.(0|[1-9][0-9]{0,2}))?\.\*\z"


@dataclass(frozen=True)
class Lookup:
    """Distinct texts in column ``entry``, with the verdict of a size check taken once.

    ``max_rows``, if given, also bounds the listed addresses of the events that are broadcast.
    """

    entries: DataFrame
    small: bool
    max_rows: int | None = None


def checked(
    entries: DataFrame, max_rows: int | None = None, max_bytes: int | None = None
) -> Lookup:
    """Store the list once, count it and its text; only one within both bounds is ever broadcast.

    Every later use, each micro-batch of a stream too, reads the copy that was counted.
    """
    entries = _stored(entries, "list")
    bound, max_rows = max_rows, BROADCAST_ROWS if max_rows is None else max_rows
    max_bytes = BROADCAST_BYTES if max_bytes is None else max_bytes
    size = entries.agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("entry")), F.lit(0)).alias("b")
    ).first()
    return Lookup(entries, size.n <= max_rows and size.b <= max_bytes, bound)


def _stored(rows: DataFrame, name: str) -> DataFrame:
    path = scratch_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def flag_listed(
    events: DataFrame, lookup: Lookup, ip: str = "source_ip", flag: str = "listed"
) -> DataFrame:
    """Add a boolean: is the address an entry of the list, by exact text? Null never is."""
    if lookup.small:
        hit = F.broadcast(lookup.entries.select(F.col("entry").alias("_entry")))
        joined = events.join(hit, F.col(ip) == F.col("_entry"), "left")
        return joined.withColumn(flag, F.col("_entry").isNotNull()).drop("_entry")
    return _flag_by_verdicts(events, lookup, ip, flag)


def _flag_by_verdicts(events: DataFrame, lookup: Lookup, ip: str, flag: str) -> DataFrame:
    """The flag for a list too large to broadcast.

    Addresses are counted first, so a hot one costs one row per task, and each distinct address
    is looked up once. If the listed ones among them are few, they act as a small list. If not,
    the addresses holding a thousandth or more of the rows, at most a thousand of them, are
    answered from a broadcast, and only the others are joined by key. The events are evaluated once
    and stored, since they are counted before they are flagged.
    """
    events = _stored(events, "events")
    counts = (
        events.groupBy(F.col(ip).alias("entry")).agg(F.count("*").alias("n"))
        .filter("entry is not null")
    )
    listed = lookup.entries.withColumn("verdict", F.lit(True))
    seen = checkpointed(
        counts.join(listed, "entry", "left").fillna(False, ["verdict"])
    )
    hits = checked(seen.filter("verdict").select("entry"), lookup.max_rows)
    if hits.small:
        return flag_listed(events, hits, ip, flag)
    total = seen.agg(F.sum("n")).first()[0]
    hot = (
        seen.filter(F.col("n") * HOT_SHARE >= total)
        .select(F.col("entry").alias("_hot"), F.col("verdict").alias("_hot_verdict"))
    )
    cold = hits.entries.select(F.col("entry").alias("_key"), F.lit(True).alias("_cold_verdict"))
    # Rows that need no lookup still pass the shuffle, so their key spreads them by input slice.
    spread = F.concat(F.lit("slice "), F.spark_partition_id())
    needs_lookup = F.col("_hot").isNull() & F.col(ip).isNotNull()
    keyed = events.join(F.broadcast(hot), F.col(ip) == F.col("_hot"), "left").withColumn(
        "_key", F.when(needs_lookup, F.concat(F.lit("ip "), F.col(ip))).otherwise(spread)
    )
    cold = cold.withColumn("_key", F.concat(F.lit("ip "), F.col("_key")))
    return (
        keyed.join(cold.hint("shuffle_merge"), "_key", "left")
        .withColumn(flag, F.coalesce("_hot_verdict", "_cold_verdict", F.lit(False)))
        .drop("_key", "_hot", "_hot_verdict", "_cold_verdict")
    )


def only_listed(events: DataFrame, lookup: Lookup, ip: str = "source_ip") -> DataFrame:
    return _filtered(events, lookup, ip, "left_semi")


def only_unlisted(events: DataFrame, lookup: Lookup, ip: str = "source_ip") -> DataFrame:
    return _filtered(events, lookup, ip, "left_anti")


def _filtered(events: DataFrame, lookup: Lookup, ip: str, how: str) -> DataFrame:
    if lookup.small:
        # A space is never an entry, since entries are trimmed. With a key that cannot be null the
        # optimizer has no null test to push down, which would extract the address once more.
        hit = F.broadcast(lookup.entries.select(F.col("entry").alias("_entry")))
        return events.join(hit, F.coalesce(F.col(ip), F.lit(" ")) == F.col("_entry"), how)
    flagged = _flag_by_verdicts(events, lookup, ip, "_listed")
    wanted = F.col("_listed") if how == "left_semi" else ~F.col("_listed")
    return flagged.filter(wanted).drop("_listed")


def _spell_prefix(head: Column, octets: int) -> Column:
    """A prefix key that no whole address can equal."""
    return head if octets == 4 else F.concat(head, F.lit(".*"))


def _prefix_keys(ip: Column, valid: Column) -> list[Column]:
    """Keys to look an address up by: its octet prefixes if it is valid, and its whole text."""
    heads = [_spell_prefix(F.substring_index(valid, ".", i), i) for i in OCTETS[:3]]
    return heads + [ip]


def expand_ranges(entries: DataFrame) -> DataFrame:
    """Entries as whole-octet prefixes; a range of odd length becomes at most 256 of them.

    Single addresses stay as they are. Text that is neither an address nor a range stays too, so
    that an exact match still finds it.
    """
    shape = rf"\A({DOTTED})/(3[0-2]|[12]?[0-9])\z"
    entry = F.col("entry")
    base = F.regexp_extract(entry, shape, 1)
    octets = F.split(base, r"\.")
    number = sum(
        F.get(octets, F.lit(i)).try_cast("bigint") * (1 << (8 * (3 - i))) for i in range(4)
    )
    ranges = (
        entries.filter(entry.rlike(shape))
        .select(number.alias("number"), F.regexp_extract(entry, shape, 2).cast("int").alias("bits"))
        .withColumn("octets", F.greatest(F.lit(1), F.ceil(F.col("bits") / 8)).cast("int"))
        # The part of the address the range fixes, counted in units of its whole-octet length.
        .withColumn("spare", F.col("octets") * 8 - F.col("bits"))
        .withColumn("fixed", F.expr("shiftright(number, 32 - bits)"))
        .withColumn("step", F.explode(F.expr("sequence(0L, shiftleft(1L, spare) - 1)")))
        .withColumn("prefix", F.expr("shiftleft(fixed, spare) + step"))
    )
    octet = [F.expr(f"shiftright(prefix, 8 * (octets - {i})) & 255").cast("string") for i in OCTETS]
    spelled = F.coalesce(*[
        F.when(F.col("octets") == i, _spell_prefix(F.concat_ws(".", *octet[:i]), i))
        for i in OCTETS
    ])
    return (
        ranges.select(spelled.alias("entry"))
        .unionByName(entries.filter(~entry.rlike(shape)).select("entry"))
        .distinct()
    )


def flag_in_ranges(
    events: DataFrame, expanded: Lookup, ip: str = "source_ip", flag: str = "listed"
) -> DataFrame:
    """Add a boolean: is the address in the list, exactly or inside a range?

    ``expanded`` holds the output of ``expand_ranges``. A small list is probed four times, by
    whole-octet prefix, from one broadcast. A large one is resolved on the distinct addresses
    first, with short prefixes from a broadcast and the others by key, and the addresses found
    then act as an exact list.
    """
    if expanded.small:
        return _probe(events, expanded, ip, flag)
    events = _stored(events, "events")
    distinct = events.select(F.col(ip).alias("entry")).filter("entry is not null").distinct()
    valid = F.when(is_ipv4(F.col("entry")), F.col("entry"))
    one, two, *long = _prefix_keys(F.col("entry"), valid)
    # Prefixes of one or two octets would be hot keys, but there are at most 65,792 of them.
    is_short = F.col("prefix").rlike(SHORT_PREFIX)
    entries = expanded.entries.withColumnRenamed("entry", "prefix")
    by_short = distinct.select("entry", F.explode(F.array(one, two, F.col("entry"))).alias("prefix")).join(
        F.broadcast(entries.filter(is_short)), "prefix", "left_semi"
    )
    by_long = distinct.select("entry", F.explode(F.array(*long)).alias("prefix")).join(
        entries.filter(~is_short), "prefix", "left_semi"
    )
    found = by_short.select("entry").unionByName(by_long.select("entry")).distinct()
    return flag_listed(events, checked(found), ip, flag)


def _probe(events: DataFrame, expanded: Lookup, ip: str, flag: str) -> DataFrame:
    probed = events.withColumn("_valid", F.when(is_ipv4(F.col(ip)), F.col(ip)))
    hits = []
    for i, key in enumerate(_prefix_keys(F.col(ip), F.col("_valid"))):
        side = F.broadcast(expanded.entries.select(F.col("entry").alias(f"_hit{i}")))
        probed = probed.join(side, key == F.col(f"_hit{i}"), "left")
        hits.append(f"_hit{i}")
    found = F.coalesce(*[F.col(name) for name in hits]).isNotNull()
    return probed.withColumn(flag, found).drop("_valid", *hits)
