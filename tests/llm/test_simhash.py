import random
import re

import numpy as np
import pytest
import xxhash
from emberwatch.llm import simhash


def brute_print(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(ids, prints):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = np.array(prints, np.uint64)
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(values[i] ^ values[i + 1 :]) <= 2):
            a, b = find(i), find(i + 1 + int(j))
            parent[max(a, b)] = min(a, b)
    least = {}
    for i, x in enumerate(ids):
        least[find(i)] = min(least.get(find(i), x), x)
    return [least[find(i)] for i in range(len(ids))]


def test_documents_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    prints = [brute_print(r.text) for r in rows]
    want = brute_components([r.doc_id for r in rows], prints)
    got = {r.doc_id: r for r in simhash.clusters(docs).collect()}
    for r, p, c in zip(rows, prints, want):
        assert (got[r.doc_id]["print"] & (2**64 - 1), got[r.doc_id].component_id) == (p, c)


@pytest.mark.parametrize("tile", [2048, 8])
def test_near_copies_link_in_any_tiling(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    draw = random.Random(5)
    prints = []
    for _ in range(25):
        base = draw.getrandbits(64)
        for _ in range(draw.randint(1, 60)):
            copy = base
            for _ in range(draw.randint(0, 4)):
                copy ^= 1 << draw.randrange(64)
            prints.append(copy)
    ids = list(range(len(prints)))
    draw.shuffle(ids)
    rows = [(i, p - 2**64 if p >= 2**63 else p) for i, p in zip(ids, prints)]
    got = simhash.clusters(None, spark.createDataFrame(rows, "doc_id long, print long")).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(zip(ids, brute_components(ids, prints)))


def test_a_chain_is_one_component(spark):
    rows = [(100 - i, (1 << i) - 1 if i < 63 else -1) for i in range(0, 64)]
    got = simhash.clusters(None, spark.createDataFrame(rows, "doc_id long, print long")).collect()
    assert {r.component_id for r in got} == {37}


def test_one_document_of_each_group_stays(spark, odd_documents):
    kept = simhash.keep_one(odd_documents)
    assert kept.columns == odd_documents.columns
    rows = kept.collect()
    # The long text, the empty ones together, and three texts of their own.
    assert sorted((r.doc_id is None, r.doc_id or 0, len(r.text or "")) for r in rows) == sorted(
        (r.doc_id is None, r.doc_id or 0, len(r.text or ""))
        for r in {brute_print(r.text): r for r in reversed(sorted(
            odd_documents.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0)))}.values()
    )


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.clusters(docs).count() == 0 and simhash.keep_one(docs).count() == 0
