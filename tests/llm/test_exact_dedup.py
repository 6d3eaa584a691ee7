import hashlib
from collections import Counter

from oracle_compare import connect, differences

from emberwatch.llm import exact_dedup, queries


def brute_digest(text):
    return hashlib.sha256("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()).hexdigest()


def brute_report(rows):
    groups = {}
    for r in rows:
        groups.setdefault(brute_digest(r.text), []).append(r.doc_id)
    found = Counter()
    for key, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        stays = 1
        for i in ids:
            found[i, keep, len(ids), i == keep and stays == 1, key] += 1
            stays -= i == keep
    return found


def reported(spark, folder, docs, loads):
    index = exact_dedup.create_index(spark, folder("index"), 4)
    parts = exact_dedup.newest_first(docs, loads)
    assert sum(p.count() for p in parts) == docs.count()
    done = [exact_dedup.absorb(index, p, str(i)) for i, p in enumerate(parts)]
    return Counter(map(tuple, exact_dedup.report(index, done).collect())), index


def test_documents_against_brute_force(spark, sf, folder):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute_report(docs.collect())
    assert any(size > 1 for _, _, size, _, _ in want)
    for loads in (1, 3):
        got, _ = reported(spark, folder, docs, loads)
        assert got == want


def test_sql(spark, sf):
    got = queries.REGISTRY["op13_exact_dedup"](spark, sf)
    assert differences(got, connect(sf), queries.SQL["op13_exact_dedup"]) is None


def test_odd_documents(spark, odd_documents, folder):
    """Nulls, ties, repeated rows, long and empty texts, and columns named like the operator's."""
    docs = odd_documents.selectExpr("*", "'x' as digest", "1 as place", "2 as copies", "'l' as load")
    want = brute_report(odd_documents.collect())
    for loads in (1, 2):
        assert reported(spark, folder, docs, loads)[0] == want
    kept = exact_dedup.keep_new(exact_dedup.create_index(spark, folder("index")), docs, "only")
    assert kept.columns == docs.columns and kept.count() == len({k for *_, k in want})


def test_no_documents_and_null_ids_alone(spark, odd_documents, folder):
    assert reported(spark, folder, odd_documents.limit(0), 2)[0] == Counter()
    docs = spark.createDataFrame([(None, "A"), (None, "a"), (None, None), (None, "")],
                                 "doc_id long, text string")
    got, _ = reported(spark, folder, docs, 2)
    assert {(size, kept, n) for (_, _, size, kept, _), n in got.items()} == {
        (2, True, 1), (2, False, 1)} and len(got) == 4


def test_hot_text(spark, folder):
    """A text that most rows hold, beside others; its rows are answered from a broadcast."""
    docs = spark.range(6000).selectExpr("id as doc_id", "if(id % 3 > 0, 'Same', concat('t', id)) as text")
    got, _ = reported(spark, folder, docs, 2)
    assert got == brute_report(docs.collect())


def test_the_index_outlives_its_session_and_a_load_runs_again(spark, folder):
    path = folder("index")
    old = spark.createDataFrame([(1, "one"), (2, "two"), (3, "TWO")], "doc_id long, text string")
    new = spark.createDataFrame([(9, "Two"), (8, "three"), (7, "three")], "doc_id long, text string")
    first = exact_dedup.create_index(spark, path, 4)
    exact_dedup.absorb(first, old, "monday")
    for part in ("digests", "sightings"):
        spark.sql(f"drop table {first.name(part)}")
    index = exact_dedup.open_index(spark, path)
    assert index.buckets == 4
    for _ in range(2):
        rows = exact_dedup.absorb(index, new, "tuesday").collect()
        assert {(r.doc_id, r.keep_id, r.kept) for r in rows} == {
            (9, 3, False), (8, 8, True), (7, 8, False)}
        assert index.table("digests").count() == 3
        sizes = {r.copies for r in exact_dedup.group_sizes(index).collect()}
        assert sizes == {1, 2, 3}


def test_the_index_is_not_shuffled(spark, folder):
    """Only the load moves; the index is read in its buckets, for the join and for the sums."""
    index = exact_dedup.create_index(spark, folder("index"), 8)
    docs = spark.range(100).selectExpr("id as doc_id", "concat('t', id) as text")
    exact_dedup.absorb(index, docs, "0")
    path = folder("texts")
    docs.select(exact_dedup.digest_of(docs.text).alias("digest")).write.parquet(path)
    dealt = spark.read.parquet(path).repartition(8, "digest")
    plan = dealt.join(index.table("digests").hint("merge"), "digest", "left_anti")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and text.count("hashpartitioning(digest") == 1
    assert "hashpartitioning" not in (
        exact_dedup.group_sizes(index)._jdf.queryExecution().executedPlan().toString())
