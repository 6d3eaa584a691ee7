"""The keys a stream has seen: segments by day, with Bloom filters that keep batches from reading them.

Most keys of a batch are new, and a filter says so without a look at the stored keys. A segment's
filter is a set of slots of SLOT_BITS bits, stored as rows by day and slot; a key has one slot and
PROBES bits in it. Only keys whose bits are all set in a segment are looked up there, and a segment none
of the batch's keys hits is not read at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.streaming.segments import FAN, Segments

SHAPE = "_key string, _run string, _batch bigint, _day string"
FILTER_SHAPE = "_day string, slot bigint, bits binary"
# Bits of a slot are what one bitmap of the engine holds.
SLOT_BITS = 32768
PROBES = 3
BITS_PER_KEY = 12
# A batch of more days than this looks at every day.
DAYS = 400


def day_of(event_time: str) -> Column:
    return F.coalesce(F.date_format(event_time, "yyyy-MM-dd"), F.lit("none"))


def _slotted(keys: DataFrame, days: dict[str, int]) -> DataFrame:
    """Keys of the given days with their ``slot``, of as many a day as its keys need."""
    spark = keys.sparkSession
    slots = [(day, -(-n * BITS_PER_KEY // SLOT_BITS)) for day, n in sorted(days.items())]
    if len(slots) <= DAYS:
        known = F.create_map(*[F.lit(x) for pair in slots for x in pair])
        sized = keys.withColumn("slots", F.element_at(known, F.col("_day"))).filter("slots is not null")
    else:
        sized = keys.join(spark.createDataFrame(slots, "_day string, slots bigint"), "_day")
    return sized.withColumn("slot", F.pmod(F.xxhash64("_key", F.lit("slot")), F.col("slots"))).drop("slots")


def _bits() -> Column:
    return F.array(*[F.pmod(F.xxhash64("_key", F.lit(i)), F.lit(SLOT_BITS)) for i in range(PROBES)])


def write_filter(keys: DataFrame, days: dict[str, int], target: str) -> None:
    bits = _slotted(keys, days).select("_day", "slot", F.explode(_bits()).alias("bit"))
    bits = bits.groupBy("_day", "slot").agg(F.bitmap_construct_agg("bit").alias("bits"))
    bits.write.parquet(f"{target}/filter")


def _is_set(bit: Column) -> Column:
    """Whether a bit of the column ``bits`` is set; the engine counts bits from each byte's low end."""
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10)
    return F.pmod(F.floor(byte.cast("int") / F.pow(F.lit(2.0), bit % 8)), F.lit(2)) == 1


class KeyStore:
    """Keys by the day of their event; whether one is known never depends on its age."""

    def __init__(self, spark: SparkSession, path: str, fan: int = FAN):
        self.spark = spark
        self.segments = Segments(spark, path, SHAPE, fan, beside=write_filter)

    def _suspects(self, own: DataFrame, segment: dict, days: list[str] | None) -> DataFrame:
        """Keys of the batch that the segment's filter does not rule out."""
        sizes = segment["days"] if days is None else {
            d: n for d, n in segment["days"].items() if d in days}
        filters = self.spark.read.schema(FILTER_SHAPE).parquet(
            f"{self.segments.path}/{segment['name']}/filter")
        filters = filters.filter(F.col("_day").isin(list(sizes))) if days is not None else filters
        held = _slotted(own, sizes).join(filters, ["_day", "slot"]).filter(F.forall(_bits(), _is_set))
        return held.select(F.lit(segment["name"]).alias("_segment"), "_key", "_day")

    def suspects(self, own: DataFrame, days: list[str] | None) -> DataFrame | None:
        """``_segment``, ``_key`` and ``_day`` of the batch's keys a segment may hold."""
        found = None
        for segment in self.segments.live():
            if days is None or not set(days).isdisjoint(segment["days"]):
                more = self._suspects(own, segment, days)
                found = more if found is None else found.unionByName(more)
        return found

    def admit(self, own: DataFrame, run: str, batch: int) -> DataFrame:
        """The batch's distinct (_key, _day) that no other batch has; they are stored as its own.

        A batch that is run again gets the same answer. The answer is cached until its caller
        releases it.
        """
        days = [r[0] for r in own.select("_day").distinct().limit(DAYS + 1).collect()]
        days = days if len(days) <= DAYS else None
        mine = (F.col("_run") == run) & (F.col("_batch") == batch)
        if self.segments.done(run, batch):
            kept = self.segments.read(days).filter(mine).select("_key", "_day")
            return own.join(kept, ["_key", "_day"], "left_semi").persist()
        new, suspects = own, self.suspects(own, days)
        if suspects is not None:
            suspects.persist()
            hit = {r[0] for r in suspects.select("_segment").distinct().collect()}
            if hit:
                rows = self.segments.read(days, hit).select("_key", "_day")
                known = suspects.drop("_segment").join(rows, ["_key", "_day"], "left_semi")
                new = own.join(known, ["_key", "_day"], "left_anti")
        new = new.persist()
        marked = new.withColumn("_run", F.lit(run)).withColumn("_batch", F.lit(batch).cast("bigint"))
        self.segments.add(marked.select("_key", "_run", "_batch", "_day"), run, batch)
        if suspects is not None:
            suspects.unpersist()
        return new
