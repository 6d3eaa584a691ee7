"""Best-fit packing of token sequences by bin completion.

Only lengths decide how pieces share sequences, and a capacity of C allows C different lengths, so
the search runs on the histogram of lengths: at most C rows, whatever the corpus. It yields
fillings with multiplicities. The pieces stay in Spark: each takes the place that its rank among
the pieces of its length gives it.

A null or empty text has only its end id and is packed like any other. Repeated rows are packed as
often as they occur. An empty table gives no rows. Columns other than ``doc_id`` and the text
are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.llm.common import stored
from emberwatch.llm.tokens import crc32, default_tokenizer, encode_documents

CAPACITY = 4096
SALTS = 64
# Bounds of the search: nodes of the tree, fillings tried at a node, steps to list fillings.
NODES = 100
BRANCHES = 8
LISTING_STEPS = 4000

# A filling: pairs of length and how often, longest first.
Filling = tuple[tuple[int, int], ...]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences needed at least: by total length, and by pieces that cannot share one.

    For a threshold k, pieces above capacity - k share with none of k or longer, pieces above
    half share with no other such piece, and the rest of at least k fills what these leave.
    """
    number = np.zeros(capacity + 2, np.int64)
    for n, c in counts.items():
        number[n] = c
    size = number * np.arange(capacity + 2)
    # Pieces longer than n, and their lengths together, at place n.
    longer = number.sum() - np.cumsum(number)
    over = size.sum() - np.cumsum(size)
    half = capacity // 2
    k = np.arange(1, half + 1)
    alone = longer[capacity - k]
    shared = longer[half] - alone
    free = shared * capacity - (over[half] - over[capacity - k])
    rest = over[k - 1] - over[half]
    more = np.maximum(0, -((free - rest) // capacity))
    best = max(-(-int(size.sum()) // capacity), int(longer[half]))
    return max([best, *(alone + shared + more).tolist()])


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing over the histogram: equal sequences are filled together."""
    by_room: dict[int, list[tuple[Filling, int]]] = {}
    rooms = np.zeros(capacity + 1, bool)

    def put(filling: Filling, times: int, room: int) -> None:
        by_room.setdefault(room, []).append((filling, times))
        rooms[room] = True

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            fitting = np.flatnonzero(rooms[length:])
            if len(fitting):
                room = int(fitting[0]) + length
                filling, times = by_room[room].pop()
                rooms[room] = bool(by_room[room])
            else:
                room, filling, times = capacity, (), left
            each = min(room // length, left)
            used = min(times, left // each)
            if used < times and filling:
                put(filling, times - used, room)
            put(filling + ((length, each),), used, room - each * length)
            left -= used * each
    return [pair for group in by_room.values() for pair in group]


def fillings(counts: dict[int, int], capacity: int, largest: int, waste: int) -> list[Filling]:
    """Undominated ways to complete a sequence that starts with the largest piece.

    Fillings are listed from long pieces to short, each maximal: no further piece fits. One is
    dominated, and left out, if one piece could stand for two or more of its pieces and leave no
    more waste, or if it wastes more than ``waste``. The least wasteful come first.
    """
    lengths = sorted((n for n, c in counts.items() if n <= capacity - largest), reverse=True)
    free = dict(counts)
    free[largest] -= 1
    found: set[Filling] = set()
    steps = 0

    def dominated(parts: list[int], room: int) -> bool:
        if len(parts) < 2:
            return False
        pair = parts[-1] + parts[-2]
        # A single free piece as long as the two shortest, or longer and still fitting.
        return any(pair <= n <= pair + room and free[n] > parts.count(n) for n in lengths)

    def extend(start: int, parts: list[int], room: int) -> None:
        nonlocal steps
        grown = False
        for i in range(start, len(lengths)):
            n = lengths[i]
            if n > room or free[n] <= parts.count(n):
                continue
            if steps >= LISTING_STEPS or len(found) >= 4 * BRANCHES:
                return
            steps += 1
            grown = True
            extend(i, [*parts, n], room - n)
        if not grown and room <= waste:
            if not any(n <= room and free[n] > parts.count(n) for n in lengths):
                if not dominated(parts, room):
                    whole = [largest, *parts]
                    found.add(tuple((n, whole.count(n)) for n in sorted(set(whole), reverse=True)))

    extend(0, [], capacity - largest)
    return sorted(found, key=lambda f: (-sum(n * k for n, k in f), f))[:BRANCHES]


def complete(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Filling, int]]:
    """Fillings with multiplicities for all pieces: bin completion with branch and bound.

    A node completes the sequence around the largest piece left, as often as the filling can be
    repeated, and keeps best fit for the rest as the incumbent where that is better. It is cut
    when its waste exceeds what a better solution may have, or its lower bound is no better.
    """
    counts = {n: c for n, c in counts.items() if c}
    incumbent = best_fit(counts, capacity)
    best = sum(times for _, times in incumbent)
    bound = lower_bound(counts, capacity)
    total = sum(n * c for n, c in counts.items())
    nodes = 0
    stack: list[tuple[dict[int, int], list[tuple[Filling, int]], int, int]] = [(counts, [], 0, 0)]
    while stack and best > bound and nodes < NODES:
        left, chosen, bins, wasted = stack.pop()
        nodes += 1
        allowed = (best - 1) * capacity - total - wasted
        if allowed < 0 or bins + lower_bound(left, capacity) >= best:
            continue
        rest = best_fit(left, capacity)
        if bins + sum(times for _, times in rest) < best:
            incumbent = chosen + rest
            best = bins + sum(times for _, times in rest)
        branches = fillings(left, capacity, max(left), allowed) if left else []
        for filling in reversed(branches):
            times = min(left[n] // k for n, k in filling)
            after = dict(left)
            for n, k in filling:
                after[n] -= k * times
                if not after[n]:
                    del after[n]
            waste = times * (capacity - sum(n * k for n, k in filling))
            stack.append((after, [*chosen, (filling, times)], bins + times, wasted + waste))
    return incumbent


def places(solution: list[tuple[Filling, int]]) -> np.ndarray:
    """Rows (length, first rank, how often in a sequence, first sequence, offset), by rank.

    One row per filling and length: at most sqrt(2 C) lengths share a sequence.
    """
    rows, taken, sequence = [], {}, 0
    for filling, times in solution:
        offset = 0
        for n, k in filling:
            rows.append((n, taken.get(n, 0), k, sequence, offset))
            taken[n] = taken.get(n, 0) + k * times
            offset += n * k
        sequence += times
    rows.sort()
    return np.array(rows, np.int64).reshape(-1, 5)


def _pieces(
    batches: Iterator[pa.RecordBatch], path: str, capacity: int
) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, ids, starts in encode_documents(batch, path):
            sizes = np.diff(starts)
            cuts = (sizes + capacity - 1) // capacity
            row = np.repeat(np.arange(high - low), cuts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            first = starts[row] + piece * capacity
            end = np.minimum(first + capacity, starts[row + 1])
            wide = np.ascontiguousarray(ids, "<u4")
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").slice(low, high - low).take(pa.array(row)),
                "piece": pa.array(piece, pa.int32()),
                "start": piece * capacity,
                "length": end - first,
                "ids_crc32": pa.array(
                    [crc32(wide[a:b]) for a, b in zip(first.tolist(), end.tolist())], pa.int64()
                ),
            })


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_documents(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY
) -> DataFrame:
    """Pieces of at most ``capacity`` ids; only longer documents are cut."""
    tokenizer = tokenizer or default_tokenizer()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        lambda batches: _pieces(batches, tokenizer, capacity), PIECE
    )


def _placed(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    keys = table[:, 0] << 42 | table[:, 1]
    for batch in batches:
        length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        at = table[np.searchsorted(keys, length << 42 | rank, "right") - 1]
        turn = rank - at[:, 1]
        columns = {n: batch.column(n) for n in batch.schema.names if n != "rank"}
        yield pa.RecordBatch.from_pydict(columns | {
            "sequence_id": at[:, 3] + turn // at[:, 2],
            "offset": at[:, 4] + turn % at[:, 2] * length,
        })


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Sequence and offset of every piece of PIECE's columns.

    Ranks come from the pieces' counts per length and salt, so a length that a third of all
    pieces share is ranked in SALTS tasks.
    """
    pieces = stored(pieces, "pieces")
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int")
    salted = pieces.withColumn("_salt", salt)
    counted = salted.groupBy("length", "_salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(
        Window.unboundedPreceding, -1
    )
    counted = stored(counted.withColumn(
        "_base", F.coalesce(F.sum("n").over(before), F.lit(0))), "piece-counts")
    # At most one row per length up to the capacity.
    sums = counted.groupBy("length").agg(F.sum("n").alias("n")).collect()
    table = places(complete({r["length"]: r["n"] for r in sums}, capacity))
    own = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        salted.withColumn("_own", F.row_number().over(own).cast("long"))
        .join(counted.select("length", "_salt", "_base"), ["length", "_salt"])
        .select(*pieces.columns, (F.col("_base") + F.col("_own") - 1).alias("rank"))
    )
    return ranked.mapInArrow(
        lambda batches: _placed(batches, table), f"{PIECE}, sequence_id long, offset long"
    )


def pack_documents(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY
) -> DataFrame:
    return pack(cut_documents(docs, tokenizer, capacity), capacity)


def sequences(placed: DataFrame, ids: DataFrame) -> DataFrame:
    """The packed id sequences, from placed pieces and ``ids`` (doc_id, ids) of a token store.

    A sequence holds at most ``capacity`` ids. Needs ``doc_id`` to be unique.
    """
    cut = placed.join(ids.select("doc_id", "ids"), "doc_id").select(
        "sequence_id", "offset",
        F.slice("ids", (F.col("start") + 1).cast("int"), F.col("length").cast("int")).alias("ids"),
    )
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return cut.groupBy("sequence_id").agg(F.flatten(ordered["ids"]).alias("ids"))
