from emberwatch.llm import licences


def test_notices_are_found_and_confirmed(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    scanner = licences.train(docs)
    lines = {(r.doc_id, i): line for r in docs.collect() for i, line in enumerate(r.text.split("\n"))}
    got = {(r.doc_id, r.paragraph): r for r in licences.scan(docs, scanner).collect()}
    marks = ("Apache License", "MIT License", "GNU General", "CC BY", "rights reserved")
    assert set(got) == {k for k, line in lines.items() if any(m in line for m in marks)}
    assert all(r.confirmed and r.probability >= scanner.threshold for r in got.values())
    odd = spark.createDataFrame([
        (0, None), (1, ""), (2, "hello\n\nThis file is released under the MIT license\nlicense"),
        (3, "My driver license expired"), (2, "x " * 100_000), (None, "Licensed under CC BY-NC 4.0."),
    ], "doc_id long, text string")
    rows = [(r.doc_id, r.paragraph, r.family, r.confirmed)
            for r in licences.scan(odd, scanner).filter("confirmed").collect()]
    assert sorted(rows, key=str) == [(2, 2, "mit", True), (None, 0, "cc-by-nc", True)]


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert licences.scan(docs).count() == 0
