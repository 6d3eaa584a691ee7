"""Token ids of a corpus in compressed files: canonical length-limited Huffman codes.

A store is a folder with two Parquet tables. ``codebook`` holds id and code length; codes follow
from them canonically (by length, then id). ``documents`` holds one row per document in ascending
``doc_id`` order over its parts: the code bits, and the bit offset of every BLOCK-th id, so that
blocks decode independently of each other.

A null or empty text has only its end id. Rows that share a ``doc_id`` are kept apart and ordered
by their length, then checksum; a null ``doc_id`` comes first. An empty table makes an empty
store. Columns other than ``doc_id`` and the text are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberwatch.llm.common import stored
from emberwatch.llm.tokens import crc32, default_tokenizer, encode_documents

MAX_BITS = 20
BLOCK = 256
PART_TOKENS = 4_000_000
STEP_TOKENS = 1_000_000

_tables: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits, by package-merge; 0 for unused ids."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need codes of more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    level, leaves = weights, [np.ones(len(order), bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([weights, pairs])
        place = np.argsort(merged, kind="stable")
        level = merged[place]
        leaves.append(place < len(weights))
    # A prefix of the last level holds the cheapest leaves and packages; each package opens
    # a prefix of the level below.
    take = 2 * len(order) - 2
    for is_leaf in reversed(leaves):
        taken = int(is_leaf[:take].sum())
        lengths[order[:taken]] += 1
        take = 2 * (take - taken)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    codes = np.zeros(len(lengths), np.uint64)
    code = last = 0
    for i in np.lexsort((np.arange(len(lengths)), lengths)):
        if lengths[i]:
            code <<= int(lengths[i]) - last
            codes[i], last = code, int(lengths[i])
            code += 1
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Id and code length for every MAX_BITS-bit prefix."""
    key = lengths.tobytes()
    if key not in _tables:
        codes = canonical_codes(lengths)
        ids, bits = np.zeros(1 << MAX_BITS, np.uint32), np.ones(1 << MAX_BITS, np.uint8)
        used = np.flatnonzero(lengths)
        used = used[np.lexsort((used, lengths[used]))]
        spans = (1 << (MAX_BITS - lengths[used].astype(np.int64))).astype(np.int64)
        if len(used):
            assert int(codes[used[0]]) == 0 and spans.sum() <= 1 << MAX_BITS
            ids[: spans.sum()] = np.repeat(used, spans)
            bits[: spans.sum()] = np.repeat(lengths[used], spans)
        _tables.clear()
        _tables[key] = ids, bits
    return _tables[key]


def pack_bits(ids: np.ndarray, starts: np.ndarray, codes: np.ndarray, lengths: np.ndarray):
    """Code bits of each document from a whole byte on: bytes, byte starts, bit place of each id.

    The last is relative to the id's own document.
    """
    bits = lengths[ids].astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(bits)])
    sizes = (np.diff(ends[starts]) + 7) // 8
    bases = np.concatenate([[0], np.cumsum(sizes)])
    inside = ends[:-1] - np.repeat(ends[starts[:-1]], np.diff(starts))
    place = inside + np.repeat(bases[:-1] * 8, np.diff(starts))
    word = place >> 5
    shifted = codes[ids] << (64 - (place & 31) - bits).astype(np.uint64)
    size = int(bases[-1] // 4 + 3)
    high = np.bincount(word, (shifted >> np.uint64(32)).astype(np.float64), size)
    low = np.bincount(word + 1, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), size)
    # The codes' bits are disjoint, so the sums are exact.
    return (high + low).astype(">u4").tobytes(), bases, inside


def unpack_bits(buffer: bytes, places: np.ndarray, counts: np.ndarray, lengths: np.ndarray):
    """Ids of blocks that start at the bit ``places``, all blocks one id at a time in step."""
    table_ids, table_bits = decoding_table(lengths)
    raw = np.frombuffer(buffer + b"\0" * 4, np.uint8).astype(np.uint32)
    windows = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    order = np.argsort(-counts, kind="stable")
    place, left = places[order].astype(np.int64), counts[order]
    target = (np.cumsum(counts) - counts)[order]
    out = np.empty(int(counts.sum()), np.uint32)
    for step in range(int(left[0]) if len(left) else 0):
        active = int(np.searchsorted(-left, -step, "left"))
        at = place[:active]
        key = (windows[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(32 - MAX_BITS)
        out[target[:active] + step] = table_ids[key]
        place[:active] += table_bits[key]
    return out


def _to_ids(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, ids, starts in encode_documents(batch, path):
            wide = np.ascontiguousarray(ids, "<u2" if ids.max(initial=0) < 1 << 16 else "<u4")
            at = (starts * wide.itemsize).tolist()
            raw = wide.tobytes()
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").slice(low, high - low),
                "n_tokens": np.diff(starts),
                "ids": pa.array([raw[a:b] for a, b in zip(at, at[1:])], pa.binary()),
            })


def _numbers(batch: pa.RecordBatch):
    """Row ranges of bounded size with their ids and each document's first place."""
    counts = batch.column("n_tokens").to_numpy()
    group = np.cumsum(counts) // STEP_TOKENS
    bounds = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(counts)]
    column = batch.column("ids")
    for low, high in zip(bounds, bounds[1:]):
        parts = []
        for n, raw in zip(counts[low:high].tolist(), column.slice(low, high - low).to_pylist()):
            parts.append(np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4"))
        if parts:
            ids = np.concatenate(parts).astype(np.int64)
            yield low, high, ids, np.concatenate([[0], np.cumsum(counts[low:high])])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for _, _, ids, _ in _numbers(batch):
            found = np.bincount(ids, minlength=len(total))
            found[: len(total)] += total
            total = found
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"id": used, "n": total[used]})


def _compressed(batches: Iterator[pa.RecordBatch], lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
    codes = canonical_codes(lengths)
    for batch in batches:
        for low, high, ids, starts in _numbers(batch):
            raw, bases, inside = pack_bits(ids, starts, codes, lengths)
            counts, at = np.diff(starts), bases.tolist()
            blocks = (counts + BLOCK - 1) // BLOCK
            ends = np.concatenate([[0], np.cumsum(blocks)])
            first = np.repeat(starts[:-1], blocks) + BLOCK * (
                np.arange(ends[-1]) - np.repeat(ends[:-1], blocks)
            )
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").slice(low, high - low),
                "n_tokens": counts,
                "code": pa.array([raw[a:b] for a, b in zip(at, at[1:])], pa.binary()),
                "checkpoints": pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()), pa.array(inside[first], pa.int64())
                ),
            })


def _decoded(batches: Iterator[pa.RecordBatch], lengths: np.ndarray):
    """Row ranges of stored documents with their ids and each document's first place."""
    for batch in batches:
        counts = batch.column("n_tokens").to_numpy()
        group = np.cumsum(counts) // STEP_TOKENS
        bounds = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(counts)]
        for low, high in zip(bounds, bounds[1:]):
            if low == high:
                continue
            raw = batch.column("code").slice(low, high - low).to_pylist()
            marks = batch.column("checkpoints").slice(low, high - low)
            bases = np.cumsum([0, *map(len, raw)])[:-1] * 8
            blocks = marks.value_lengths().to_numpy().astype(np.int64)
            places = marks.flatten().to_numpy() + np.repeat(bases, blocks)
            n = counts[low:high]
            sizes = np.full(len(places), BLOCK, np.int64)
            sizes[np.cumsum(blocks) - 1] = n - (blocks - 1) * BLOCK
            ids = unpack_bits(b"".join(raw), places, sizes, lengths)
            yield batch, low, high, ids, np.concatenate([[0], np.cumsum(n)])


def _described(batches: Iterator[pa.RecordBatch], lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch, low, high, ids, starts in _decoded(batches, lengths):
        at = starts.tolist()
        yield pa.RecordBatch.from_pydict({
            "part": batch.column("part").slice(low, high - low),
            "doc_id": batch.column("doc_id").slice(low, high - low),
            "n_tokens": np.diff(starts),
            "ids_crc32": pa.array([crc32(ids[a:b]) for a, b in zip(at, at[1:])], pa.int64()),
        })


def _listed(batches: Iterator[pa.RecordBatch], lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch, low, high, ids, starts in _decoded(batches, lengths):
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id").slice(low, high - low),
            "ids": pa.ListArray.from_arrays(
                pa.array(starts, pa.int32()), pa.array(ids.astype(np.int32))
            ),
        })


def write_store(docs: DataFrame, path: str, tokenizer: str | None = None) -> None:
    """Encode every document and write the store.

    Ids are stored once between the global counts and the coding. The parts' bounds are
    percentiles of ``doc_id``, and only coded documents are shuffled.
    """
    tokenizer = tokenizer or default_tokenizer()
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        lambda batches: _to_ids(batches, tokenizer), "doc_id long, n_tokens long, ids binary"
    )
    spark = docs.sparkSession
    ids = stored(ids, "token-ids", compression="zstd")
    counts = ids.select("n_tokens", "ids").mapInArrow(_counted, "id long, n long")
    # One row per id of the vocabulary, however large the corpus.
    counts = {r["id"]: r["n"] for r in counts.groupBy("id").agg(F.sum("n").alias("n")).collect()}
    weights = np.zeros(max(counts, default=-1) + 1, np.int64)
    for i, n in counts.items():
        weights[i] = n
    lengths = code_lengths(weights)
    used = np.flatnonzero(lengths).tolist()
    book = [(i, int(lengths[i]), int(weights[i])) for i in used]
    spark.createDataFrame(book, "id long, bits int, n long").coalesce(1).write.parquet(
        f"{path}/codebook"
    )
    parts = max(1, -(-int(weights.sum()) // PART_TOKENS))
    steps = [i / parts for i in range(1, parts)]
    bounds = ids.agg(F.percentile_approx("doc_id", steps, 10 * parts)).first()[0] if steps else []
    coded = ids.mapInArrow(
        lambda batches: _compressed(batches, lengths),
        "doc_id long, n_tokens long, code binary, checkpoints array<long>",
    )
    part = F.lit(0)
    if bounds:
        cuts = F.array(*[F.lit(int(b)) for b in sorted(set(bounds))])
        after = F.aggregate(cuts, F.lit(0), lambda n, c: n + (F.col("doc_id") > c).cast("int"))
        part = F.coalesce(after, F.lit(0))
    coded = coded.withColumn("part", part)
    coded.repartitionById(parts, F.col("part")).sortWithinPartitions(
        "doc_id", "n_tokens", F.crc32("code")
    ).write.option("compression", "uncompressed").parquet(f"{path}/documents")


def read_lengths(spark: SparkSession, path: str) -> np.ndarray:
    """Code lengths by id; the codebook has one row per id of the vocabulary at most."""
    rows = spark.read.parquet(f"{path}/codebook").select("id", "bits").collect()
    lengths = np.zeros(max((r["id"] for r in rows), default=-1) + 1, np.uint8)
    for r in rows:
        lengths[r["id"]] = r["bits"]
    return lengths


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Ids of every document of a store."""
    lengths = read_lengths(spark, path)
    return spark.read.parquet(f"{path}/documents").mapInArrow(
        lambda batches: _listed(batches, lengths), "doc_id long, ids array<int>"
    )


def describe_store(spark: SparkSession, path: str) -> DataFrame:
    """Place, length and checksum of every document's ids, decoded from the files.

    ``start`` counts all ids before the document: a running sum within its part after the
    totals of the parts before it.
    """
    lengths = read_lengths(spark, path)
    rows = spark.read.parquet(f"{path}/documents").mapInArrow(
        lambda batches: _described(batches, lengths),
        "part int, doc_id long, n_tokens long, ids_crc32 long",
    )
    rows = stored(rows, "token-places")
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("doc_id", "n_tokens", "ids_crc32").rowsBetween(
        Window.unboundedPreceding, -1
    )
    return rows.join(totals, "part").select(
        "doc_id",
        (F.col("base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("start"),
        "n_tokens", "ids_crc32",
    )
