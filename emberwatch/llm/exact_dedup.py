"""Exact duplicates against a persistent index of text digests.

The index is a folder of two tables, both bucketed and sorted by digest: ``digests`` holds each known
text once with the document that stays for it, ``sightings`` how many rows each load had of it. A load
is cut to one row per text by a map-side combined aggregation, meets the index in a sort-merge
anti-join that moves only the load (the index lies in its buckets already), and what is new is
appended. Texts are equal when identical after lower-casing A-Z; a null text counts as empty.

Within a load the row with the largest ``doc_id`` stays; a text known from an earlier load keeps the
document it has, so loads that go from large ids to small ones keep the largest of all. Null ids
come last. Of rows that share text and id exactly one stays. Text of any length is digested whole;
columns other than ``doc_id`` and ``text`` do not matter and may have any name; an empty load adds nothing.
A load that is run again under its name finds its own digests and gives the same answer.
"""

from __future__ import annotations

import hashlib
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.llm.common import join_facts, stored

# Digests a bucket is meant to hold at most; about 200 MB of index.
BUCKET_ROWS = 4_000_000
LEAST_BUCKETS = 32
LARGE = 2**63 - 1

_TABLES = {
    "digests": "digest binary, keep_id bigint, load string",
    "sightings": "digest binary, copies bigint, load string",
}


@dataclass(frozen=True)
class Index:
    """An index folder that this session knows as two bucketed tables."""

    spark: SparkSession
    path: str
    buckets: int

    def name(self, part: str) -> str:
        return f"{part}_{hashlib.md5(self.path.encode()).hexdigest()}"

    def table(self, part: str) -> DataFrame:
        return self.spark.table(self.name(part))

    def append(self, part: str, rows: DataFrame) -> None:
        """Rows already dealt to the buckets, so that a load adds one file to each."""
        rows.select(*self.table(part).columns).write.insertInto(self.name(part))


def buckets_for(rows: int) -> int:
    """Buckets for an index that is to hold about this many texts; fixed when it is made."""
    return max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS))


def create_index(spark: SparkSession, path: str, buckets: int = LEAST_BUCKETS) -> Index:
    """A new empty index; its bucket count is written beside it."""
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{path}/shape")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> Index:
    """An index that this or an earlier session made."""
    buckets = spark.read.schema("buckets int").parquet(f"{path}/shape").first()[0]
    index = Index(spark, path, buckets)
    for part, columns in _TABLES.items():
        spark.sql(
            f"create table if not exists {index.name(part)} ({columns}) using parquet "
            f"clustered by (digest) sorted by (digest) into {buckets} buckets "
            f"location '{path}/{part}'"
        )
    return index


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def absorb(index: Index, docs: DataFrame, load: str) -> DataFrame:
    """Add a load to the index; ``doc_id``, ``digest``, ``keep_id`` and ``kept`` of each of its rows.

    The texts are read once; what is shuffled and joined are digests. A text that a large share of
    the rows holds is one row per task before the shuffle, and its rows are answered from a
    broadcast of at most a thousand such texts.
    """
    rows = stored(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), digest_of(F.col("text")).alias("digest"),
        F.monotonically_increasing_id().alias("place"),
    ), "dedup-rows")
    # The largest id, then the first row; nulls are smaller than any id.
    best = F.max(F.struct("doc_id", (F.lit(LARGE) - F.col("place")).alias("from_end")))
    texts = rows.groupBy("digest").agg(best.alias("best"), F.count("*").alias("copies"))
    texts = stored(texts.select(
        "digest", F.col("best.doc_id").alias("own_id"),
        (F.lit(LARGE) - F.col("best.from_end")).alias("own_place"), "copies",
    ), "dedup-texts")
    dealt = texts.withColumn("load", F.lit(load)).repartition(index.buckets, "digest")
    fresh = dealt.join(index.table("digests").hint("merge"), "digest", "left_anti")
    index.append("digests", fresh.withColumnRenamed("own_id", "keep_id"))
    again = index.table("sightings").filter(F.col("load") == load)
    index.append("sightings", dealt.join(again.hint("merge"), "digest", "left_anti"))
    known = index.table("digests").select("digest", "keep_id", (F.col("load") == load).alias("own"))
    verdicts = stored(
        texts.repartition(index.buckets, "digest").join(known.hint("merge"), "digest").select(
            "digest", "copies", "keep_id", F.when(F.col("own"), F.col("own_place")).alias("stays")
        ), "dedup-verdicts",
    )
    kept = F.coalesce(F.col("place") == F.col("stays"), F.lit(False))
    return join_facts(rows, verdicts, "digest").select(
        "doc_id", "digest", "keep_id", kept.alias("kept")
    )


def group_sizes(index: Index) -> DataFrame:
    """``digest`` and the rows that all loads had of it; the buckets need no shuffle."""
    return index.table("sightings").groupBy("digest").agg(F.sum("copies").alias("copies"))


def keep_new(index: Index, docs: DataFrame, load: str) -> DataFrame:
    """The rows of a load that stay, with their own columns; texts the index knows go.

    The rows are matched by id and digest, which spreads the copies of one text.
    """
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                         digest_of(F.col("text")).alias("digest"))
    verdicts = absorb(index, docs, load).filter("kept").select("doc_id", "digest")
    found = packed.join(
        verdicts.select(F.col("digest").alias("_digest"), F.col("doc_id").alias("_id")),
        (F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi",
    )
    return found.dropDuplicates(["digest"]).select("row.*")


def newest_first(docs: DataFrame, loads: int) -> list[DataFrame]:
    """The rows in ``loads`` parts of about equal size, the largest ids first and nulls last."""
    cuts = docs.select(F.percentile_approx(
        F.col("doc_id").cast("long"), [i / loads for i in range(1, loads)], 1000)).first()[0] or []
    at = F.coalesce(sum((F.col("doc_id") > F.lit(c)).cast("int") for c in cuts), F.lit(-1)) if cuts \
        else F.lit(0)
    return [docs.filter(at == i if i else at <= 0) for i in range(len(cuts), -1, -1)]


def report(index: Index, loads: list[DataFrame]) -> DataFrame:
    """Every row of the absorbed loads with the document kept for it and the size of its group."""
    rows = loads[0]
    for more in loads[1:]:
        rows = rows.unionByName(more)
    return join_facts(rows, stored(group_sizes(index), "dedup-sizes"), "digest").select(
        "doc_id", "keep_id", F.col("copies").alias("group_size"), "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


_LETTERS = f"'{string.ascii_uppercase}', '{string.ascii_lowercase}'"
SQL = f"""
with d as (select doc_id, sha256(translate(coalesce(text, ''), {_LETTERS})) as h from documents)
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
       doc_id = max(doc_id) over g as kept, h as text_sha256
from d window g as (partition by h)
"""
