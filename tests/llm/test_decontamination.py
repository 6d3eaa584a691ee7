import random

import numpy as np
from emberwatch.llm import decontamination as d


def brute(docs, index):
    out = {}
    for r in docs:
        held = set(d.shingles(d.clean_words(r.text)))
        for item in index.items:
            parts = item.question + item.answer + item.seam
            share = sum(s in held for s in parts) / len(parts)
            if share >= d.OVERLAP:
                out[r.doc_id, item.item_id] = round(share, 9)
    return out


def test_tables_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): round(r.overlap, 9) for r in d.contaminated(docs, items).collect()}
    index = d.Index([(r.item_id, *d.parts_of(r.text)) for r in items.collect()])
    assert got == brute(docs.collect(), index) and got
    clean = {r.doc_id for r in d.without_contaminated(docs, items).collect()}
    assert clean == {r.doc_id for r in docs.collect()} - {k[0] for k in got}


def test_bounds_lose_no_segment():
    draw = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    index = d.Index([
        (i, " ".join(draw.choices(words, [1 / (j + 1) for j in range(60)], k=draw.randint(8, 80))), "")
        for i in range(300)
    ])
    for chunk in index.chunks:
        asked = [np.array(sorted(draw.sample(range(len(chunk.upper)), draw.randint(0, 25))), int)
                 for _ in range(200)]
        first = np.cumsum([0, *map(len, asked)])[:-1]
        for threshold in (0.2, 0.4, 0.7):
            found = d.block_max_wand(chunk, np.concatenate(asked), first, threshold)
            got = {(p, s) for p, s, _ in found}
            want = set()
            for i, terms in enumerate(asked):
                score = chunk.impacts[chunk.place[terms]].sum(axis=0).reshape(-1)
                want |= {(i, int(s)) for s in np.flatnonzero(score >= threshold)}
            assert got == want


def test_questions_and_answers_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(d, "MAX_ITEMS", 4)
    items = [(i, f"which of the many words number {i} would be the right one here",
              f"it is the word {i} and nothing else at all") for i in range(20)]
    items += [(50, None, None), (51, "too few", "words"), (None, "a null id item with enough words", "")]
    frame = spark.createDataFrame(items, "item_id long, question string, answer string")
    docs = spark.createDataFrame([
        (1, "Before. " + " ".join(items[3][1:]).upper() + "! after"), (2, items[4][1]), (3, None),
        (4, ""), (5, "word " * 3000 + " ".join(items[7][1:])), (5, " ".join(items[7][1:])),
        (6, "A null id item, with enough words"),
    ], "doc_id long, text string")
    got = sorted((r.doc_id, -1 if r.item_id is None else r.item_id)
                 for r in d.contaminated(docs, frame).collect())
    assert got == [(1, 3), (5, 7), (5, 7), (6, -1)]
    assert sorted(r.doc_id for r in d.without_contaminated(docs, frame).collect()) == [2, 3, 4]


def test_odd_documents_and_empty_tables(spark, odd_documents):
    items = spark.createDataFrame([(1, odd_documents.first().text[:300])], "item_id long, text string")
    kept = d.without_contaminated(odd_documents, items)
    assert kept.columns == odd_documents.columns
    assert kept.count() == odd_documents.count() - 2
    none = items.limit(0)
    assert d.contaminated(odd_documents, none).count() == 0
    assert d.without_contaminated(odd_documents, none).count() == odd_documents.count()
    assert d.contaminated(odd_documents.limit(0), items).count() == 0
