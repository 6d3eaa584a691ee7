import corpus_pipeline
from emberwatch.llm import decontamination, quality, secrets
from emberwatch.llm.tokens import default_tokenizer
from test_simhash import brute_components, brute_print
from test_spans import secret_base
from tokenizers import Tokenizer


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    judged = {r.doc_id: r.kept for r in quality.score_documents(
        docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    rows = [r for r in docs.orderBy("doc_id").collect() if judged[r.doc_id]]
    ids = [r.doc_id for r in rows]
    first = brute_components(ids, [brute_print(r.text) for r in rows])
    rows = [r for r, c in zip(rows, first) if r.doc_id == c]
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    index = decontamination.Index([(r.item_id, *decontamination.parts_of(r.text)) for r in items])
    rows = [r for r in rows if all(
        decontamination.verify(i, r.text)[2] < decontamination.OVERLAP for i in index.items)]
    left = spark.createDataFrame(rows, docs.schema)
    masked = {r.doc_id: r.text for r in secrets.redact(left).collect()}
    assert all(masked[r.doc_id] == r.text for r in rows if not secret_base(r.text))
    tokenizer = Tokenizer.from_file(default_tokenizer())
    want = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in masked.items()}
    got = {}
    for r in corpus_pipeline.run(spark, sf).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want and len(got) < len(judged)


def test_stages_take_odd_and_empty_documents(spark, sf, odd_documents):
    for docs in (odd_documents, odd_documents.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
        last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
        assert last.count() == sum(1 for _ in last.collect())
