import hashlib
import zlib
from collections import Counter

import pytest
from oracle_compare import connect, differences

from emberwatch.llm import merkle, queries


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_leaf(row, text):
    parts = [None if v is None else str(v) for v in (row.doc_id, row.source, row.lang, row.n_chars, text)]
    return digest("".join("-" if p is None else f"{len(p.encode())}:{p}" for p in parts))


def climb(nodes):
    """Root and, for each node, its (place, siblings) level by level; straight from the definition."""
    levels, trails, at = [nodes], [[] for _ in nodes], list(range(len(nodes)))
    while len(levels[-1]) > 1:
        below = levels[-1]
        runs = [below[i : i + 8] for i in range(0, len(below), 8)]
        for trail, i in zip(trails, range(len(nodes))):
            run = runs[at[i] // 8]
            trail.append((at[i] % 8, [x for j, x in enumerate(run) if j != at[i] % 8]))
            at[i] //= 8
        levels.append([digest("".join(r)) for r in runs])
    return levels[-1][0], trails


def brute_audit(rows):
    langs = {}
    for row in rows:
        langs.setdefault(row.lang, []).append((row, brute_leaf(row, row.text)))
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    roots, own = [], {}
    for name in names:
        langs[name].sort(key=lambda x: (x[0].doc_id is not None, x[0].doc_id or 0, x[1]))
        root, own[name] = climb([leaf for _, leaf in langs[name]])
        roots.append(root)
    root, tops = climb(roots)
    found = []
    for name, subroot, top in zip(names, roots, tops):
        for (row, leaf), trail in zip(langs[name], own[name]):
            text, node = row.text, leaf
            if row.doc_id is not None and text is not None and zlib.crc32(str(row.doc_id).encode()) % 3 == 0:
                node = brute_leaf(row, "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
            for at, others in trail + top:
                node = digest("".join(others[:at]) + node + "".join(others[at:]))
            proof = digest("".join(x for _, others in trail + top for x in others))
            found.append((row.doc_id, leaf, subroot, root, proof, node, node == root))
    return Counter(found)


def audited(docs, **options):
    return Counter(map(tuple, merkle.audit(docs, merkle.lower_some, **options).collect()))


@pytest.mark.parametrize("levels", [4, 1])
def test_documents_against_brute_force(spark, sf, levels):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute_audit(docs.collect())
    assert audited(docs, levels=levels) == want
    assert 0 < sum(not r[-1] for r in want) < len(want)


def test_sql(spark, sf):
    got = queries.REGISTRY["op11_merkle_manifest"](spark, sf)
    assert differences(got, connect(sf), queries.SQL["op11_merkle_manifest"]) is None


def test_a_language_of_several_superblocks_and_many_languages(spark):
    """4,098 leaves give a last superblock of two; 70 languages give the upper tree two levels."""
    docs = spark.range(4168).selectExpr(
        "id as doc_id", "concat('Text ', id) as text", "concat('s', id % 3) as source",
        "case when id < 4098 then 'aa' else concat('l', id) end as lang", "id as n_chars",
    )
    assert audited(docs) == brute_audit(docs.collect())


def test_odd_documents(spark, odd_documents):
    """Nulls, ties, repeated rows, long and empty texts, and columns named like the operator's."""
    docs = odd_documents.selectExpr("*", "'x' as tree", "1 as pos", "'y' as node", "2 as block")
    assert audited(docs) == brute_audit(odd_documents.collect())
    assert audited(docs, levels=1) == brute_audit(odd_documents.collect())


def test_one_document_and_none(spark, odd_documents):
    one = odd_documents.filter("doc_id = 5")
    row = merkle.audit(one).collect()[0]
    assert row.leaf == row.subroot == row.root == row.folded_root and row.verified
    assert row.proof_sha256 == digest("")
    assert merkle.audit(one.limit(0), merkle.lower_some).collect() == []
