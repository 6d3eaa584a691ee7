import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from emberwatch.llm import packing, token_store, tokens
from tokenizers import Tokenizer

ODD = [
    "a.b c,d e.,f", "THE Don't we've é́ ẖ H̱x 12,345.6 <|endoftext|>x <|ENDOFTEXT|> ...,,, it's.",
    "", None, "日本語 テスト。ab中c", "ﬁne ŉ ǅ İstanbul ß ẞ", ", .a b. ,c", "x" * 5000, "q w\x85e \x1cz",
]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(tokens.default_tokenizer())


def whole(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def test_words_give_the_ids_of_the_whole_text(plain):
    draw = random.Random(2)
    texts = ODD + ["".join(draw.choices("abZ .,'é́ß<|>1 \n\t日ẖH̱", k=draw.randint(0, 60)))
                   for _ in range(500)]
    ids, starts = tokens.encoder(tokens.default_tokenizer()).encode(pa.array(texts))
    for i, text in enumerate(texts):
        assert ids[starts[i] : starts[i + 1]].tolist() == whole(plain, text)[:-1]


def test_codes_are_short_enough_and_prefix_free():
    counts = np.array([2**i for i in range(40)] + [0, 1, 1])
    lengths = token_store.code_lengths(counts, 12)
    assert lengths.max() <= 12 and lengths[40] == 0
    assert sum(2.0 ** -int(n) for n in lengths[lengths > 0]) <= 1
    assert token_store.code_lengths(np.array([0, 7])).tolist() == [0, 1]


def test_code_lengths_are_optimal_without_a_limit():
    import heapq

    counts = np.random.default_rng(3).integers(1, 1000, 200)
    heap = [int(c) for c in counts]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        pair = heapq.heappop(heap) + heapq.heappop(heap)
        cost += pair
        heapq.heappush(heap, pair)
    assert int((token_store.code_lengths(counts) * counts).sum()) == cost


def test_store_gives_back_every_id(spark, folder, plain, monkeypatch):
    monkeypatch.setattr(token_store, "PART_TOKENS", 2000)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "null id"), (3, "again"), (-9, "first")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = folder("store")
    token_store.write_store(docs, path)
    at = 0
    key = lambda r: (r[0] is not None, r[0] or 0, len(whole(plain, r[1])))
    got = sorted(token_store.describe_store(spark, path).collect(), key=lambda r: r.start)
    for r, (doc_id, text) in zip(got, sorted(rows, key=key), strict=True):
        ids = whole(plain, text)
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert tuple(r) == (doc_id, at, len(ids), crc)
        at += len(ids)
    back = {r.doc_id: r.ids for r in token_store.read_store(spark, path).collect()}
    assert back[7] == whole(plain, ODD[7])


def test_empty_store(spark, folder):
    docs = spark.createDataFrame([], "doc_id long, text string")
    path = folder("store")
    token_store.write_store(docs, path)
    assert token_store.describe_store(spark, path).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_packing_is_valid_and_no_worse_than_best_fit(seed):
    draw = random.Random(seed)
    size = draw.choice([10, 100, 1000])
    counts = {}
    for _ in range(draw.randint(1, 80)):
        n = draw.randint(1, size) if seed % 2 else draw.randint(size // 4, size // 2 + 1)
        counts[n] = counts.get(n, 0) + 1
    solution = packing.complete(counts, size)
    used = {}
    for filling, times in solution:
        assert sum(n * k for n, k in filling) <= size
        for n, k in filling:
            used[n] = used.get(n, 0) + k * times
    assert used == counts
    bins = sum(t for _, t in solution)
    fit = sum(t for _, t in packing.best_fit(counts, size))
    assert packing.lower_bound(counts, size) <= bins <= fit


def test_search_beats_best_fit_where_it_can():
    counts = {6: 1, 5: 1, 4: 1, 3: 1, 2: 1}
    assert packing.lower_bound(counts, 10) == sum(t for _, t in packing.complete(counts, 10)) == 2
    assert sum(t for _, t in packing.complete({44: 2, 24: 2, 27: 4, 26: 2, 23: 2}, 100)) <= 4


def test_documents_fill_sequences_without_gaps(spark, odd_documents, plain):
    got = packing.pack_documents(odd_documents, capacity=64).collect()
    filled = {}
    for r in got:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    pieces = {}
    for r in odd_documents.collect():
        ids = whole(plain, r.text)
        for i in range(0, len(ids), 64):
            key = (r.doc_id, i // 64, i, len(ids[i : i + 64]),
                   zlib.crc32(np.array(ids[i : i + 64], "<u4").tobytes()))
            pieces[key] = pieces.get(key, 0) + 1
    found = {}
    for r in got:
        key = (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
        found[key] = found.get(key, 0) + 1
    assert found == pieces


def test_packed_ids(spark, folder, plain):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "f"), (3, None)], "doc_id long, text string")
    path = folder("store")
    token_store.write_store(docs, path)
    placed = packing.pack_documents(docs, capacity=4)
    rows = packing.sequences(placed, token_store.read_store(spark, path)).collect()
    assert sorted(len(r.ids) for r in rows) == [1, 4, 4]
    assert sorted(i for r in rows for i in r.ids) == sorted(
        sum((whole(plain, t) for t in ("a b c d e", "f", None)), []))


def test_nothing_to_pack(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(docs).count() == 0
