"""Product codes of vectors, assigned through memoised grid cells.

Components become integers floor(256 * x) and vectors are cut into PARTS equal parts, each coded by its
nearest entry of the part's codebook (squared distance, ties to the lower index). Codebooks start
as the parts of the smallest ``vec_id``s and are replaced ROUNDS times by the floored means of
their parts.

A part lies in a coarse grid cell of side 2^CELL_BITS. For each cell met, a task remembers the
entries that can be nearest to some point of it: those whose least distance to the cell's box is not
above the smallest of all entries' greatest distances. Only these are evaluated exactly for the
parts in the cell, so the result is that of comparing with every entry. A round sends one row of sums
per entry and task; the codebooks, of fixed size, are all that the driver holds.

Dropped: null vectors, null or non-finite components, components whose integer needs more than
REACH_BITS bits, and vectors that are not of the table's dimension, the length that most usable vectors
have (of equally many the smaller; a positive multiple of PARTS). A null ``vec_id`` is coded like
any other and comes last for the first codebook; rows of equal id are told apart by their vector, and
repeated rows are coded each. Fewer rows than ENTRIES give fewer entries. A null label is a
group of its own. Other columns may have any name. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.common import join_facts, stored
from emberwatch.operators.topk import first_rows

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
CELL_BITS = 5
REACH_BITS = 26
# Cells a task remembers at once for a part; past that it starts anew.
MEMO_CELLS = 200_000


class CellMemo:
    """Nearest entries of one part's codebook, with the candidates of each cell met so far."""

    def __init__(self, entries: np.ndarray, bits: int = CELL_BITS):
        self.entries, self.bits = entries.astype(np.int64), bits
        self.known: dict[bytes, np.ndarray] = {}
        self.evaluated = 0

    def _candidates(self, cells: np.ndarray) -> list[np.ndarray]:
        """Entries not dominated across each cell's box, in ascending order."""
        low = (cells << self.bits)[:, None, :]
        high = low + (1 << self.bits) - 1
        under, over = low - self.entries[None], self.entries[None] - high
        least = (np.maximum(np.maximum(under, over), 0) ** 2).sum(axis=2)
        most = (np.maximum(-over, -under) ** 2).sum(axis=2)
        open_ = least <= most.min(axis=1, keepdims=True)
        return np.split(np.nonzero(open_)[1], np.cumsum(open_.sum(axis=1))[:-1])

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of and squared distance to the nearest entry of every point."""
        cells, group = np.unique(points >> self.bits, axis=0, return_inverse=True)
        group = group.ravel()
        keys = [c.tobytes() for c in cells]
        new = [i for i, k in enumerate(keys) if k not in self.known]
        if len(self.known) + len(new) > MEMO_CELLS:
            self.known.clear()
            new = list(range(len(keys)))
        for low in range(0, len(new), 4096):
            some = new[low : low + 4096]
            for i, found in zip(some, self._candidates(cells[some])):
                self.known[keys[i]] = found
        lists = [self.known[k] for k in keys]
        sizes = np.array([len(x) for x in lists])
        flat, first = np.concatenate(lists), np.cumsum(sizes) - sizes
        each = sizes[group]
        starts = np.cumsum(each) - each
        at = np.arange(each.sum()) + np.repeat(first[group] - starts, each)
        chosen = flat[at]
        self.evaluated += len(chosen)
        away = ((np.repeat(points, each, axis=0) - self.entries[chosen]) ** 2).sum(axis=1)
        # The smallest distance, then the smallest index, in one number.
        best = np.minimum.reduceat(away * ENTRIES + chosen, starts)
        return best % ENTRIES, best // ENTRIES


def _parts(batch: pa.RecordBatch) -> np.ndarray:
    """(rows, PARTS, width) integers of a batch."""
    rows = batch.num_rows
    values = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.int64).reshape(rows, PARTS, -1)


def _memos(books: list[np.ndarray]) -> list[CellMemo]:
    return [CellMemo(book) for book in books]


def _assigned(memos: list[CellMemo], parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = [memo.nearest(parts[:, i]) for i, memo in enumerate(memos)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _sums(batches: Iterator[pa.RecordBatch], books: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """One row per used entry: its parts' componentwise sums and their number."""
    memos = _memos(books)
    total = counts = None
    for batch in batches:
        if not batch.num_rows:
            continue
        parts = _parts(batch)
        code, _ = _assigned(memos, parts)
        if total is None:
            total = np.zeros((PARTS, ENTRIES, parts.shape[2]), np.int64)
            counts = np.zeros((PARTS, ENTRIES), np.int64)
        for i in range(PARTS):
            np.add.at(total[i], code[:, i], parts[:, i])
            counts[i] += np.bincount(code[:, i], minlength=ENTRIES)
    if total is not None:
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict({
            "part": pa.array(part, pa.int32()), "entry": pa.array(entry, pa.int32()),
            "n": pa.array(counts[part, entry], pa.int64()),
            "sums": pa.array(list(total[part, entry]), pa.list_(pa.int64())),
        })


def _coded(batches: Iterator[pa.RecordBatch], books: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    memos = _memos(books)
    for batch in batches:
        if not batch.num_rows:
            continue
        code, away = _assigned(memos, _parts(batch))
        yield pa.RecordBatch.from_pydict({
            "vec_id": batch.column("vec_id"), "group": batch.column("group"),
            "code": pa.array([row.tobytes().hex() for row in code.astype(np.uint8)]),
            "error": pa.array(away.sum(axis=1), pa.int64()),
        })


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``group`` (of the label) and integer ``vector`` of the rows that are coded, stored."""
    x = F.col("embedding")
    fit = F.lit(float(1 << REACH_BITS))
    scaled = F.transform(x, lambda v: F.floor(v.cast("double") * SCALE))
    good = x.isNotNull() & F.forall(x, lambda v: F.coalesce(
        ~F.isnan(v) & (F.abs(v.cast("double")) * SCALE < fit), F.lit(False)))
    group = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    rows = stored(vectors.filter(good).select(
        F.col("vec_id").cast("long").alias("vec_id"), group.alias("group"), scaled.alias("vector"),
    ), "vector-integers")
    size = F.size("vector")
    lengths = rows.filter((size > 0) & (size % PARTS == 0)).groupBy(size.alias("size")).count()
    most = lengths.orderBy(F.desc("count"), "size").first()
    return rows.filter(size == F.lit(most["size"] if most else 0))


def first_books(rows: DataFrame) -> list[np.ndarray]:
    """Every part's codebook: that part of the ENTRIES smallest ids, in ascending order."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("vector").asc()]
    least = first_rows(rows.select("vec_id", "vector"), ENTRIES, *order).collect()
    width = len(least[0].vector) // PARTS if least else 1
    whole = np.array([r.vector for r in least], np.int64).reshape(len(least), PARTS, width)
    return [whole[:, i] for i in range(PARTS)]


def improved(rows: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round over all rows; unused entries stay."""
    held = rows.sparkSession.sparkContext.broadcast(books)
    sums = rows.select("vector").mapInArrow(
        lambda batches: _sums(batches, held.value), "part int, entry int, n long, sums array<long>"
    )
    width = books[0].shape[1]
    total = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)]
    found = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *total)
    new = [book.copy() for book in books]
    for r in found.toArrow().to_pylist():
        new[r["part"]][r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return new


def books_digest(books: list[np.ndarray]) -> str:
    flat = ",".join(str(v) for book in books for v in book.ravel().tolist())
    return hashlib.sha256(flat.encode()).hexdigest()


def encode(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``code``, ``error``, ``label_error`` and ``codebooks_sha256`` of every kept row."""
    rows = usable(vectors)
    books = first_books(rows)
    if len(books[0]):
        for _ in range(ROUNDS):
            books = improved(rows, books)
    held = vectors.sparkSession.sparkContext.broadcast(books)
    coded = stored(rows.mapInArrow(
        lambda batches: _coded(batches, held.value),
        "vec_id long, group string, code string, error long",
    ), "vector-codes")
    groups = stored(coded.groupBy("group").agg(
        F.sum("error").alias("label_error"), F.count("*").alias("copies")), "vector-groups")
    return join_facts(coded, groups, "group").select(
        "vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256")
    )


def _round_sql(n: int) -> str:
    """Assignment to book ``n`` and the book after it."""
    return f"""
near{n} as (select p.vec_id, p.label, p.part, p.v, min(struct_pack(d := list_sum(list_transform(
                range(1, len(p.v) + 1), lambda i: (p.v[i] - b.v[i]) * (p.v[i] - b.v[i]))),
              entry := b.entry)) as best
            from parts p join book{n} b on p.part = b.part group by p.vec_id, p.label, p.part, p.v),
mean{n} as (select part, entry, list(m order by i) as v from
              (select part, best.entry as entry, i, floor(sum(v[i])::double / count(*))::bigint as m
               from near{n}, unnest(range(1, len(v) + 1)) as u(i) group by all) group by part, entry),
book{n + 1} as (select b.part, b.entry, coalesce(m.v, b.v) as v
                from book{n} b left join mean{n} m using (part, entry))"""


SQL = f"""
with kept as (select vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as w
              from embeddings where embedding is not null
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as (select vec_id, label, part, w[part * len(w) // {PARTS} + 1:(part + 1) * len(w) // {PARTS}] as v
          from kept, unnest(range({PARTS})) as u(part)),
book0 as (select part, row_number() over (partition by part order by vec_id) - 1 as entry, v
          from parts where vec_id in (select vec_id from kept order by vec_id limit {ENTRIES})),
{_round_sql(0)},
{_round_sql(1)},
{_round_sql(2)},
coded as (select vec_id, label, string_agg(format('{{:02x}}', best.entry), '' order by part) as code,
                 sum(best.d)::bigint as error from near2 group by vec_id, label),
books as (select sha256(string_agg(array_to_string(v, ','), ',' order by part, entry)) as h from book2)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error,
       h as codebooks_sha256 from coded, books
"""
