"""Language of a text: known words first, shorter and shorter character n-grams for the rest.

Counts come from at most TRAIN_DOCUMENTS labelled documents per language, chosen by a hash of their
id; the model keeps words and n-grams seen often enough, at most MAX_WORDS and MAX_GRAMS
of them. A known word adds its log frequency in each language; an unseen one the mean of those of
its longest known n-grams. Prediction reads the text alone, in blocks, without a shuffle.

Words are maximal runs of letters in lower case. A null text, or one without a letter, is `und`
with score 0, as is any text when nothing could be learned. Ties go to the language that sorts first.
A null ``lang`` or ``doc_id`` teaches nothing; repeated rows count as often as they
occur. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.common import stored
from emberwatch.llm.tokens import text_slices

TRAIN_DOCUMENTS = 4000
MIN_WORD, MIN_GRAM = 3, 5
MAX_WORDS, MAX_GRAMS = 100_000, 100_000
ORDERS = (5, 4, 3, 2, 1)
SMOOTHING = 0.5
UNKNOWN = "und"

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Model:
    """Log frequencies by language of words and of n-grams by order."""

    languages: list[str]
    words: pa.Array
    word_scores: np.ndarray
    # For each order: sorted hashes and the scores beside them.
    grams: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)


def _points(words: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words between boundary marks, and the word of each."""
    words = pa.array(words, pa.string()) if isinstance(words, list) else words
    marked = pc.binary_join_element_wise("\x02", words, "\x03", "")
    text = "".join(marked.to_pylist())
    owner = np.repeat(np.arange(len(words)), pc.utf8_length(marked).to_numpy().astype(np.int64))
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64), owner


def _hashes(points: np.ndarray, owner: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every n-gram that lies in one word, and its word."""
    size = max(0, len(points) - order + 1)
    total = np.zeros(size, np.uint64)
    for k in range(order):
        total = total * _FACTOR + points[k : k + size] + np.uint64(1)
    inside = owner[:size] == owner[order - 1 : order - 1 + size]
    return total[inside], owner[:size][inside]


def held_out(doc_id: Column, fold: int = 1, folds: int = 3) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)) == fold, F.lit(False))


def _log(counts: np.ndarray) -> np.ndarray:
    """Smoothed log frequencies, each row centred so that it only compares languages."""
    scores = np.log((counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * len(counts)))
    return scores - scores.mean(axis=1, keepdims=True)


def fit(labelled: DataFrame, documents: int = TRAIN_DOCUMENTS) -> Model:
    """Counts from a bounded sample of labelled documents (doc_id, text, lang)."""
    rows = labelled.filter("lang is not null and text is not null and doc_id is not null")
    sizes = rows.groupBy("lang").count().withColumn(
        "_share", F.least(F.lit(1.0), F.lit(float(documents)) / F.col("count"))
    )
    sizes = stored(sizes.select("lang", "_share"), "language-shares")
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / F.lit(1e6)
    words = rows.join(sizes, "lang").filter(draw < F.col("_share")).select(
        "lang", F.explode(F.split(F.lower("text"), "[^\\p{L}]+")).alias("word")
    ).filter("word <> ''")
    words = stored(words.groupBy("lang", "word").agg(F.count("*").alias("n")), "language-words")
    grams = [
        F.transform(
            F.sequence(F.lit(1), F.length("_marked") - (n - 1)),
            lambda i, n=n: F.struct(F.lit(n).alias("order"), F.substring("_marked", i, n)
                                    .alias("gram")),
        )
        for n in ORDERS
    ]
    marked = words.withColumn("_marked", F.concat(F.lit("\x02"), "word", F.lit("\x03")))
    usable = [F.when(F.length("_marked") >= n, g).otherwise(F.slice(g, 1, 0))
              for n, g in zip(ORDERS, grams)]
    counted = marked.select("lang", "n", F.explode(F.concat(*usable)).alias("g")).groupBy(
        "lang", "g.order", "g.gram"
    ).agg(F.sum("n").alias("n"))

    def table(frame: DataFrame, key: list[str], least: int, most: int) -> list:
        whole = frame.groupBy(*key).agg(
            F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("lang", "n")))
            .alias("by"),
        )
        # At most ``most`` rows reach the driver.
        return whole.filter(F.col("total") >= least).orderBy(
            F.desc("total"), *key
        ).limit(most).collect()

    found = table(words, ["word"], MIN_WORD, MAX_WORDS)
    pieces = table(counted, ["order", "gram"], MIN_GRAM, MAX_GRAMS)
    languages = sorted({x for r in [*found, *pieces] for x in r["by"]})
    place = {x: i for i, x in enumerate(languages)}

    def matrix(rows: list) -> np.ndarray:
        counts = np.zeros((len(rows), len(languages)))
        for i, r in enumerate(rows):
            for x, n in r["by"].items():
                counts[i, place[x]] = n
        return _log(counts) if len(rows) else counts

    model = Model(languages, pa.array([r["word"] for r in found], pa.string()), matrix(found))
    for order in ORDERS:
        own = [r for r in pieces if r["order"] == order]
        if own:
            hashes = np.array([_gram_hash(r["gram"]) for r in own], np.uint64)
            at = np.argsort(hashes)
            model.grams[order] = hashes[at], matrix(own)[at]
    return model


def _gram_hash(gram: str) -> int:
    total = 0
    for c in gram:
        total = (total * int(_FACTOR) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return total


def _backoff(model: Model, words: pa.Array) -> np.ndarray:
    """Scores of unseen words."""
    scores = np.zeros((len(words), len(model.languages)))
    points, owner = _points(words)
    waiting = np.ones(len(words), bool)
    for order in ORDERS:
        if order not in model.grams or not waiting.any():
            continue
        keep = waiting[owner]
        points, owner = points[keep], owner[keep]
        hashes, of = _hashes(points, owner, order)
        table, values = model.grams[order]
        at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
        hit = table[at] == hashes
        at, of = at[hit], of[hit]
        counts = np.bincount(of, minlength=len(words))
        for k in range(len(model.languages)):
            total = np.bincount(of, values[at, k], len(words))
            scores[:, k] += np.divide(total, counts, out=np.zeros(len(words)), where=counts > 0)
        waiting &= counts == 0
    return scores


def predict_texts(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    clean = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}]+", " ")
    split = pc.ascii_split_whitespace(clean)
    lengths = pc.list_value_length(split).to_numpy().astype(np.int64)
    coded = split.flatten().dictionary_encode()
    found = pc.index_in(coded.dictionary, value_set=model.words)
    slots = pc.fill_null(found, -1).to_numpy().astype(np.int64)
    scores = np.zeros((len(slots), len(model.languages)))
    scores[slots >= 0] = model.word_scores[slots[slots >= 0]]
    fresh = np.flatnonzero(slots < 0)
    if len(fresh):
        scores[fresh] = _backoff(model, coded.dictionary.take(pa.array(fresh)))
    row = np.repeat(np.arange(len(texts)), lengths)
    at = coded.indices.to_numpy()
    empty = pc.equal(coded.dictionary, "").to_numpy(zero_copy_only=False)
    filled = ~empty[at] if len(at) else np.zeros(0, bool)
    row, at = row[filled], at[filled]
    counts = np.bincount(row, minlength=len(texts))
    totals = np.stack(
        [np.bincount(row, scores[at, k], len(texts)) for k in range(len(model.languages))], axis=1
    ) if model.languages else np.zeros((len(texts), 0))
    if not model.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    best = totals.argmax(axis=1)
    # A share of the evidence that grows with the square root of the words.
    scaled = totals / np.sqrt(np.maximum(counts, 1))[:, None]
    odds = np.exp(scaled - scaled.max(axis=1, keepdims=True))
    share = odds[np.arange(len(texts)), best] / odds.sum(axis=1)
    names = [model.languages[b] if n else UNKNOWN for b, n in zip(best.tolist(), counts.tolist())]
    return names, np.where(counts > 0, share, 0.0)


def _predicted(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high in text_slices(batch.column("text")):
            if low == high:
                continue
            part = batch.slice(low, high - low)
            names, shares = predict_texts(model, part.column("text"))
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id"), "held_out": part.column("held_out"),
                "lang_pred": pa.array(names, pa.string()), "score": pa.array(shares, pa.float64()),
            })


def predict(docs: DataFrame, model: Model) -> DataFrame:
    doc_id = F.col("doc_id").cast("long")
    return docs.select(
        doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "text"
    ).mapInArrow(
        lambda batches: _predicted(batches, model),
        "doc_id long, held_out boolean, lang_pred string, score double",
    )


def identify(docs: DataFrame) -> DataFrame:
    """Every document's language, learned from the rows that are not held out."""
    return predict(docs, fit(docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")))
