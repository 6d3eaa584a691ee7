"""Filtered replay of a log: selection, counters and the escaped line sink."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.functions.text import clip_text, escape_quotes
from emberwatch.operators.topk import first_rows
from emberwatch.session import scratch_path

# Limits up to the first are a top-k; a chunk of at most so many keys is ranked in one task.
TOP_ROWS = 10_000
RANK_KEYS = 100_000
# Chunks that a chunk with more keys is cut into.
EDGE_PARTS = 64


def matches(category: str | None, columns: list[str] | None = None) -> Column:
    """Rows to replay; no category means all, and a null or absent one never equals any."""
    if not category:
        return F.lit(True)
    if columns is not None and "category" not in columns:
        return F.lit(False)
    return F.coalesce(F.col("category") == F.lit(category), F.lit(False))


def _keyed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows with the key of their place; rows of equal key are equal in every column."""
    content = F.xxhash64(F.to_json(F.struct("*")))
    return rows.withColumn("_key", F.struct(*order, content.alias("_content")))


def _places(
    rows: DataFrame, category: str | None, order: Sequence[str], chunk: Sequence[str] | None
) -> DataFrame:
    """Key, hit flag and chunk of every row, stored once for the cut and the counts.

    Chunks follow each other in the order: file splits if ``chunk`` names them, else the parts of
    a range shuffle of the keys alone.
    """
    keyed = _keyed(rows, order).withColumn("_hit", matches(category, rows.columns))
    if chunk:
        return _stored(keyed.select("_key", "_hit", F.struct(*chunk).alias("_chunk")))
    return _stored(_chunked(keyed.select("_key", "_hit")))


def _chunked(keys: DataFrame, parts: int | None = None) -> DataFrame:
    """Ranges of keys; a given number of them is kept, otherwise small ones may be joined."""
    dealt = keys.repartitionByRange(*([parts] if parts else []), "_key")
    return dealt.withColumn("_chunk", F.spark_partition_id())


def _stored(rows: DataFrame) -> DataFrame:
    path = scratch_path(rows.sparkSession, "replay-places")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _cut(places: DataFrame, limit: int, keys: int = RANK_KEYS) -> DataFrame | None:
    """One row, the key of the last row to replay and how many of its equals are; None if fewer match.

    Hits are counted per chunk. The chunk the limit falls into is cut into chunks again, until it
    has at most ``keys`` different keys, which are then added up in order; equal rows are one key
    with a count, so no number of them keeps a chunk large.
    """
    level = places.filter("_hit").groupBy("_chunk", "_key").agg(F.count("*").alias("_n"))
    need = limit
    while True:
        upto = level.groupBy("_chunk").agg(F.sum("_n").alias("_rows"), F.count("*").alias("_keys"))
        upto = upto.withColumn("_upto", F.sum("_rows").over(Window.orderBy("_chunk")))
        edge = _stored(upto.filter(F.col("_upto") >= need).orderBy("_chunk").limit(1))
        sizes = edge.select("_rows", "_keys", "_upto").first()
        if sizes is None:
            return None
        need -= sizes["_upto"] - sizes["_rows"]
        inside = level.join(F.broadcast(edge.select("_chunk")), "_chunk").select("_key", "_n")
        if sizes["_keys"] <= keys:
            break
        level = _stored(_chunked(inside, EDGE_PARTS))
    summed = inside.withColumn("_upto", F.sum("_n").over(Window.orderBy("_key")))
    return summed.filter(F.col("_upto") >= need).orderBy("_key").limit(1).select(
        "_key", (F.lit(need) - F.col("_upto") + F.col("_n")).alias("copies")
    )


def select_replay(
    rows: DataFrame, category: str | None = None, limit: int = 100, order: Sequence[str] = ("seq",),
    chunk: Sequence[str] | None = None, top: int = TOP_ROWS,
) -> DataFrame:
    """The first ``limit`` matching rows in reading order; 0 means all, less than 0 none.

    Rows that ``order`` leaves tied are ordered by their content. Up to ``top`` rows are a top-k in one
    pass. More are found by their last key, for which ``chunk`` may name coarser leading columns of
    the same order, file and split for a file scan, which saves a shuffle of the keys.
    """
    hits = rows.filter(matches(category, rows.columns))
    if limit <= 0:
        return hits if limit == 0 else hits.limit(0)
    if limit <= top:
        return first_rows(_keyed(hits, order), limit, F.col("_key").asc()).drop("_key")
    cut = _cut(_places(rows, category, order, chunk), limit)
    if cut is None:
        return hits
    cut = _stored(cut)
    keyed, at = _keyed(hits, order), cut.select("_key").scalar()
    chosen = keyed.filter(F.col("_key") < at).unionByName(
        keyed.filter(F.col("_key") == at).limit(cut.first()["copies"])
    )
    return chosen.drop("_key")


def count_replay(
    rows: DataFrame, category: str | None = None, limit: int = 100, order: Sequence[str] = ("seq",),
    chunk: Sequence[str] | None = None, top: int = TOP_ROWS,
) -> DataFrame:
    """Replayed rows, and rows skipped before the limit was reached, in one row."""
    hit = F.col("_hit")
    keyed = _keyed(rows, order).withColumn("_hit", matches(category, rows.columns)).select("_key", "_hit")
    if limit <= 0:
        return keyed.filter(F.lit(limit == 0)).agg(
            F.count_if(hit).alias("injected"), F.count_if(~hit).alias("skipped"))
    if limit <= top:
        first = first_rows(keyed.filter(hit).select("_key"), limit, F.col("_key").asc())
        last = first.agg(F.max("_key").alias("_key"), F.count("*").alias("_n"))
        at = last.select(F.when(F.col("_n") == limit, F.col("_key"))).scalar()
    else:
        keyed = _places(rows, category, order, chunk)
        cut = _cut(keyed, limit)
        at = cut.select("_key").scalar() if cut is not None else F.lit(None)
    before = F.coalesce(F.col("_key") < at, F.lit(True))
    return keyed.withColumn("_before", before).agg(
        F.least(F.lit(limit), F.count_if(hit)).alias("injected"),
        F.count_if(~hit & F.col("_before")).alias("skipped"),
    )


def replay_lines(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The line as sent, and the shorter text shown for it; absent columns take their defaults."""
    log = F.coalesce(F.col("log"), F.lit("")) if "log" in rows.columns else F.lit("")
    category = F.col("category") if "category" in rows.columns else F.lit("unknown")
    return rows.select(
        *keep,
        category.alias("category"),
        escape_quotes(log).alias("value"),
        clip_text(log, 80).alias("shown"),
        clip_text(log, 100).alias("dry_run"),
    )


def write_lines(lines: DataFrame, path: str) -> None:
    """Append the escaped lines as text; a failed task fails the job and the replay stops."""
    lines.select("value").write.mode("append").text(path)
