import math

import __spark_entry__ as driver
import pytest
from emberwatch.llm import quality
from oracle_compare import connect, differences
from pyspark.sql import functions as F


@pytest.mark.parametrize("name", ["op5_chat_formatting", "op8_quality_rules"])
def test_query_matches_sql(spark, sf, name):
    rows = driver.queries()[name](spark, sf)
    assert differences(rows, connect(sf), driver.oracle_sql()[name]) is None


@pytest.mark.parametrize("k, n, rate", [(0, 5, 0.1), (3, 1000, 0.0125), (40, 10_000, 0.0125),
                                        (9, 10, 0.95), (1000, 200_000, 0.0125), (5, 5, 0.2)])
def test_binomial_tail_is_exact(spark, k, n, rate):
    want = 1.0 if k >= n * rate else sum(
        math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1)
                 + j * math.log(rate) + (n - j) * math.log1p(-rate)) for j in range(k + 1))
    row = spark.createDataFrame([(k, n)], "k long, n long")
    got = row.select(quality.binomial_tail(F.col("k"), F.col("n"), rate)).first()[0]
    assert got == pytest.approx(want, rel=1e-9)


def _labelled(spark, good, bad):
    rows = [(i, "en", False, 0) for i in range(good)] + [(good + i, "en", False, 300)
                                                       for i in range(bad)]
    measured = spark.createDataFrame(
        rows, "doc_id long, lang string, base_failed boolean, share_symbols long"
    ).withColumns({f"share_{r}": F.lit(0).cast("long") for r in quality.RULES[1:]})
    labels = spark.createDataFrame(
        [(i, int(i < good)) for i in range(good + bad)] + [(None, 1), (10**9, 0), (0, None)],
        "doc_id long, quality int",
    )
    return measured, labels


def test_few_labels_set_no_cutoff(spark):
    cut = quality.calibrate(*_labelled(spark, 100, 50)).first()
    assert cut.cut_symbols is None


def test_laxest_cutoff_that_catches_all_bad_ones(spark):
    cut = quality.calibrate(*_labelled(spark, 2000, 50)).first()
    assert cut.cut_symbols == 300 and cut.cut_capitals is None


def test_odd_documents(spark, odd_documents):
    labels = spark.createDataFrame([(1, 1), (None, 0)], "doc_id long, quality int")
    judged = quality.score_documents(odd_documents, labels).collect()
    assert sum(r.kept for r in judged) == 4 and len(judged) == odd_documents.count()
    kept = quality.keep_good(odd_documents, labels)
    assert kept.columns == odd_documents.columns
    assert sorted(len(r.text) for r in kept.collect())[-2:] == sorted(
        len(r.text or "") for r in odd_documents.collect() if r.doc_id == 1)[-2:]
    assert quality.keep_good(odd_documents.limit(0), labels.limit(0)).count() == 0


def test_repeated_windows(spark):
    eight = "a b c d e f g h"
    rows = [(1, f"{eight} x {eight}"), (2, f"{eight} {eight} {eight}"), (3, "z " * 9), (4, eight)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("x"))
    got = {r.doc_id: r.n_repeat_words for r in quality.features(docs).collect()}
    assert got == {1: 16, 2: 24, 3: 9, 4: 0}
