from emberwatch.llm import language


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and 0.2 < len(held) / len(rows) < 0.5
    assert sum(r.lang == r.lang_pred for r in held) >= 0.99 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_unseen_words_fall_back_to_shorter_grams(spark):
    train = spark.createDataFrame(
        [(i, "the thing that they think", "en") for i in range(20)]
        + [(100 + i, "größe fließt über straße", "de") for i in range(20)],
        "doc_id long, text string, lang string",
    )
    model = language.fit(train)
    import pyarrow as pa

    names, shares = language.predict_texts(
        model, pa.array(["Thinking", "GRÖSSEN ließ", "the", None, "", "12 !", "qqq", "ß"]))
    assert names[:3] == ["en", "de", "en"] and names[3:6] == ["und"] * 3 and names[7] == "de"
    assert names[6] == "de" and shares[3:6].tolist() == [0, 0, 0]


def test_odd_documents_and_nothing_to_learn(spark, odd_documents):
    rows = language.identify(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    assert all(r.lang_pred == "und" for r in rows if r.doc_id in (2, 3, 4))
    assert language.identify(odd_documents.limit(0)).count() == 0
    plain = odd_documents.withColumn("lang", odd_documents["lang"].substr(1, 0))
    blank = plain.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r.lang_pred for r in language.identify(blank).collect()} == {"und"}
