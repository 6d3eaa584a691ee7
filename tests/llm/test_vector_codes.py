import hashlib
from collections import Counter, defaultdict

import numpy as np
from oracle_compare import connect, differences

from emberwatch.llm import queries, vector_codes


def brute_encode(rows):
    kept = [(r.vec_id, [int(np.floor(256 * float(x))) for x in r.embedding], r.label) for r in rows
            if r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // 16
    parts = [[v[p * width : (p + 1) * width] for p in range(16)] for _, v, _ in kept]
    books = [[parts[i][p] for i in range(min(64, len(kept)))] for p in range(16)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(books[p]))

    for _ in range(2):
        held = [defaultdict(list) for _ in range(16)]
        for row in parts:
            for p in range(16):
                held[p][nearest(p, row[p])[1]].append(row[p])
        for p in range(16):
            for i, xs in held[p].items():
                books[p][i] = [sum(c) // len(xs) for c in zip(*xs)]
    flat = ",".join(str(c) for book in books for entry in book for c in entry)
    sha = hashlib.sha256(flat.encode()).hexdigest()
    coded, groups = [], Counter()
    for (vec_id, _, label), row in zip(kept, parts):
        best = [nearest(p, row[p]) for p in range(16)]
        error = sum(d for d, _ in best)
        groups[label] += error
        coded.append((vec_id, "".join(f"{i:02x}" for _, i in best), error, label))
    return Counter((v, c, e, groups[label], sha) for v, c, e, label in coded)


def encoded(rows):
    return Counter(map(tuple, vector_codes.encode(rows).collect()))


def test_embeddings_against_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert encoded(rows) == brute_encode(rows.collect())


def test_sql(spark, sf):
    got = queries.REGISTRY["op12_vector_codes"](spark, sf)
    assert differences(got, connect(sf), queries.SQL["op12_vector_codes"]) is None


def test_odd_vectors(spark):
    """Nulls everywhere, non-finite components, wrong lengths, ties, repeats, clashing names."""
    draw = np.random.default_rng(3)
    good = [(int(i) if i % 7 else None, [float(x) for x in draw.normal(0, 1, 32).astype(np.float32)],
             int(i) % 3 if i % 5 else None) for i in range(120)]
    rows = good + good[:4] + [(5, good[9][1], 1), (6, [-0.001] * 32, None)]
    bad = [(1, None, 1), (2, [None] * 32, 1), (3, [float("nan")] * 32, 1), (4, [float("inf")] + [0.0] * 31, 2),
           (5, [], 1), (6, [1.0] * 16, 1), (7, [1.0] * 33, 1), (8, [3e38] + [0.0] * 31, 1)]
    shape = "vec_id long, embedding array<float>, label int, `group` string, vector int, code int"
    more = spark.createDataFrame([(*r, "g", 1, 2) for r in rows + bad], shape)
    clean = spark.createDataFrame([(*r, "g", 1, 2) for r in rows], shape)
    assert encoded(more) == brute_encode(clean.collect())


def test_few_and_no_vectors(spark):
    shape = "vec_id long, embedding array<float>, label int"
    rows = [(i, [float(i)] * 16, 1) for i in (3, 1, 2)]
    got = vector_codes.encode(spark.createDataFrame(rows, shape)).collect()
    assert {(r.vec_id, r.code, r.error) for r in got} == {
        (1, "00" * 16, 0), (2, "01" * 16, 0), (3, "02" * 16, 0)}
    for none in (rows[:0], [(1, None, 1)], [(1, [1.0], 2)]):
        assert vector_codes.encode(spark.createDataFrame(none, shape)).collect() == []


def test_cells_give_the_nearest_entry_and_are_remembered():
    """Equal distances go to the lower index; a cell met again costs no new candidates."""
    draw = np.random.default_rng(1)
    entries = draw.integers(-60, 60, (64, 4))
    entries[40] = entries[3]
    points = np.concatenate([draw.integers(-300, 300, (3000, 4)), entries, entries + 1])
    memo = vector_codes.CellMemo(entries)
    for _ in range(2):
        index, away = memo.nearest(points)
        full = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (index == full.argmin(axis=1)).all() and (away == full.min(axis=1)).all()
        cells = len(memo.known)
    assert len(memo.known) == cells and memo.evaluated < 2 * full.size / 3


def test_a_full_memo_starts_anew(monkeypatch):
    monkeypatch.setattr(vector_codes, "MEMO_CELLS", 50)
    draw = np.random.default_rng(2)
    entries, points = draw.integers(-90, 90, (64, 4)), draw.integers(-900, 900, (400, 4))
    memo = vector_codes.CellMemo(entries)
    for low in range(0, 400, 40):
        index, _ = memo.nearest(points[low : low + 40])
        full = ((points[low : low + 40, None] - entries[None]) ** 2).sum(axis=2)
        assert (index == full.argmin(axis=1)).all()
