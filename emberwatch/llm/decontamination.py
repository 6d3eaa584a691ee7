"""Benchmark decontamination: training passages against a BM25 index of test items.

Items are cut in segments of at most SEGMENT words, the postings of a block-max WAND index; impacts
are BM25 weights over a segment's own score, so a passage that holds a whole segment scores 1.
Passages are windows of two strides of SEGMENT words, so that each run of SEGMENT words lies in one,
and all of them are queries. Bounds prune them, a slice of documents at a time, and no segment that
reaches the threshold is lost. Every hit is verified on the whole document: of the item's
five-word shingles, those of its question, of its answer and between them, at least OVERLAP must
occur in it.

Items are read in blocks of MAX_ITEMS rows and MAX_CHARS characters, each its own pass, so that what
is sent to the tasks is bounded. A null or empty text, or one under five words, holds no
item; items under five words have no shingle to verify and are left out. Repeated items and
documents give a row for each pair. Empty tables give no rows. Other columns stay untouched.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.tokens import text_slices

K1, B = 1.2, 0.75
SEGMENT = 48
BLOCK = 8
CHUNK = 128
THRESHOLD = 0.4
SHINGLE = 5
OVERLAP = 0.8
MAX_ITEMS = 5_000
MAX_CHARS = 5_000_000

# ASCII characters other than letters and digits part words.
_PARTS = str.maketrans({chr(c): " " for c in range(128) if not chr(c).isalnum()})
_PATTERN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SENTENCE = re.compile(r"(?<=[.!?\n])\s+")


def words_of(text: str) -> list[str]:
    return text.lower().translate(_PARTS).split(" ")


def clean_words(text: str | None) -> list[str]:
    return [w for w in words_of(text or "") if w]


def parts_of(text: str) -> tuple[str, str]:
    """Question and answer of an item that has only one text: its last sentence answers."""
    sentences = _SENTENCE.split(text.strip())
    return " ".join(sentences[:-1]), sentences[-1]


def shingles(words: list[str]) -> list[str]:
    """Five-word shingles; fewer words are one shingle."""
    if not words:
        return []
    return [" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))]


@dataclass
class Item:
    item_id: int | None
    question: list[str]
    answer: list[str]
    seam: list[str]


@dataclass
class Chunk:
    """Some segments: a term's local number, its upper bound, block maxima and block impacts."""

    local: np.ndarray
    upper: np.ndarray
    maxima: np.ndarray
    # Where the impacts of (term, block) stand; place 0 is all zeros.
    place: np.ndarray
    impacts: np.ndarray
    items: np.ndarray


class Index:
    """Inverted index over the segments of items."""

    def __init__(self, rows: list[tuple[int | None, str, str]]):
        self.items: list[Item] = []
        segments: list[tuple[int, list[str]]] = []
        for item_id, question, answer in rows:
            q, a = clean_words(question), clean_words(answer)
            whole = q + a
            if len(whole) < SHINGLE:
                continue
            seam = [
                " ".join(whole[i : i + SHINGLE])
                for i in range(max(0, len(q) - SHINGLE + 1), len(q))
                if i + SHINGLE <= len(whole)
            ] if q and a else []
            self.items.append(Item(
                item_id, shingles(q) if len(q) >= SHINGLE else [],
                shingles(a) if len(a) >= SHINGLE else [], seam,
            ))
            count = max(1, round(len(whole) / SEGMENT))
            size = -(-len(whole) // count)
            if size > SEGMENT:
                size = -(-len(whole) // (count + 1))
            for i in range(0, len(whole), size):
                segments.append((len(self.items) - 1, whole[i : i + size]))
        held = Counter(w for _, s in segments for w in set(s))
        self.terms = {w: i for i, w in enumerate(sorted(held))}
        average = sum(len(s) for _, s in segments) / max(1, len(segments))
        idf = {w: math.log(1 + (len(segments) - n + 0.5) / (n + 0.5)) for w, n in held.items()}
        self.chunks = []
        for low in range(0, len(segments), CHUNK):
            self.chunks.append(self._chunk(segments[low : low + CHUNK], idf, average))
        self.vocabulary = pa.array(sorted(held), pa.string())

    def _chunk(self, segments, idf, average) -> Chunk:
        found: dict[int, list[tuple[int, float]]] = {}
        for s, (_, words) in enumerate(segments):
            tf = Counter(words)
            norm = K1 * (1 - B + B * len(words) / average)
            raw = {w: idf[w] * n * (K1 + 1) / (n + norm) for w, n in tf.items()}
            own = sum(raw.values())
            for w, x in raw.items():
                found.setdefault(self.terms[w], []).append((s, x / own))
        local = np.full(len(self.terms) + 1, -1, np.int64)
        blocks = -(-len(segments) // BLOCK)
        place = np.zeros((len(found), blocks), np.int32)
        impacts = [np.zeros(BLOCK, np.float32)]
        for n, (term, pairs) in enumerate(sorted(found.items())):
            local[term] = n
            for segment, impact in pairs:
                if not place[n, segment // BLOCK]:
                    place[n, segment // BLOCK] = len(impacts)
                    impacts.append(np.zeros(BLOCK, np.float32))
                impacts[place[n, segment // BLOCK]][segment % BLOCK] = impact
        impacts = np.stack(impacts)
        maxima = impacts.max(axis=1)[place]
        return Chunk(local, maxima.max(axis=1, initial=0), maxima, place, impacts,
                     np.array([i for i, _ in segments]))


def block_max_wand(chunk: Chunk, terms: np.ndarray, first: np.ndarray, threshold: float):
    """(passage, segment, score) of all that reach the threshold, for many passages together.

    terms: distinct local terms, passage after passage; first: where each passage starts. As in
    WAND, upper bounds decide what is scored: a passage goes on if its terms' bounds together
    reach the threshold, then only in blocks whose own maxima do, and there all segments of
    the block are scored. Sums are in single precision, so bounds keep a margin.
    """
    margin = 1e-4
    lengths = np.diff(np.append(first, len(terms)))
    full = np.flatnonzero(lengths > 0)
    total = np.add.reduceat(chunk.upper[terms], first[full]) if len(full) else np.empty(0)
    full = full[total >= threshold - margin]
    step = max(1, 4_000_000 // (64 * chunk.maxima.shape[1]))
    for low in range(0, len(full), step):
        some = full[low : low + step]
        at, starts = _spans(first[some], lengths[some])
        bound = np.add.reduceat(chunk.maxima[terms[at]], starts, axis=0)
        passage, block = np.nonzero(bound >= threshold - margin)
        if not len(passage):
            continue
        chosen = some[passage]
        at, starts = _spans(first[chosen], lengths[chosen])
        place = chunk.place[terms[at], np.repeat(block, lengths[chosen])]
        score = np.add.reduceat(chunk.impacts[place], starts, axis=0)
        hit, inside = np.nonzero(score >= threshold)
        yield from zip(chosen[hit].tolist(), (block[hit] * BLOCK + inside).tolist(),
                       score[hit, inside].tolist())


def _spans(first: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of several ranges in a row, and where each range starts among them."""
    starts = np.cumsum(lengths) - lengths
    return np.arange(lengths.sum()) + np.repeat(first - starts, lengths), starts


def _candidates(index: Index, texts: pa.Array, threshold: float) -> dict[tuple[int, int], float]:
    """Best score of (row, item) over the rows' passages."""
    clean = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), _PATTERN, " ")
    split = pc.ascii_split_whitespace(clean)
    offsets = split.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    found = pc.index_in(split.flatten(), value_set=index.vocabulary)
    term = pc.fill_null(found, -1).to_numpy().astype(np.int64)
    lengths = np.diff(offsets)
    units = lengths // SEGMENT + 1
    row = np.repeat(np.arange(len(lengths)), units)
    unit = np.repeat(np.cumsum(units) - units, lengths)
    unit += (np.arange(len(term)) - np.repeat(offsets[:-1], lengths)) // SEGMENT
    # A passage is a unit and the next of the same row; the last unit of a row ends one alone.
    best: dict[tuple[int, int], float] = {}
    for chunk in index.chunks:
        local = chunk.local[term]
        known = np.flatnonzero(local >= 0)
        at, what = unit[known], local[known]
        again = np.flatnonzero((at > 0) & (row[at] == row[at - 1]))
        size = len(chunk.upper)
        pairs = np.unique(np.concatenate([at * size + what, (at[again] - 1) * size + what[again]]))
        first = np.searchsorted(pairs, np.arange(len(row)) * size)
        for passage, segment, score in block_max_wand(chunk, pairs % size, first, threshold):
            key = int(row[passage]), int(chunk.items[segment])
            best[key] = max(score, best.get(key, 0.0))
    return best


def verify(item: Item, text: str) -> tuple[float, float, float]:
    """Shares of question, answer and all shingles that occur in the text."""
    padded = " " + " ".join(clean_words(text)) + " "
    hits = [[f" {s} " in padded for s in part] for part in (item.question, item.answer, item.seam)]
    share = [sum(h) / len(h) if h else float("nan") for h in hits[:2]]
    return share[0], share[1], sum(map(sum, hits)) / sum(map(len, hits))


def _matches(texts: pa.Array, index: Index, threshold: float, overlap: float):
    for low, high in text_slices(texts):
        if low == high:
            continue
        for (row, i), score in sorted(
            _candidates(index, texts.slice(low, high - low), threshold).items()
        ):
            question, answer, both = verify(index.items[i], texts[low + row].as_py())
            if both >= overlap:
                yield low + row, index.items[i].item_id, score, question, answer, both


MATCH = "item_id long, score double, question_overlap double, answer_overlap double, overlap double"


def _found(batches: Iterator[pa.RecordBatch], index: Index, threshold: float, overlap: float):
    for batch in batches:
        rows = list(_matches(batch.column("text"), index, threshold, overlap))
        at, item, *shares = zip(*rows) if rows else [()] * 6
        doubles = [pa.array(x, pa.float64()) for x in shares]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(item, pa.int64()),
             doubles[0], *[pc.if_else(pc.is_nan(x), None, x) for x in doubles[1:]]],
            ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "overlap"],
        )


def _clean(batches: Iterator[pa.RecordBatch], index: Index, threshold: float, overlap: float):
    for batch in batches:
        rows = {r[0] for r in _matches(batch.column("text"), index, threshold, overlap)}
        keep = np.ones(batch.num_rows, bool)
        keep[list(rows)] = False
        yield batch.filter(pa.array(keep))


def item_blocks(items: DataFrame) -> Iterator[Index]:
    """Indexes over blocks of the items, each of bounded rows and characters.

    items: ``item_id`` and either ``question`` and ``answer`` or ``text``.
    """
    names = items.columns
    if "question" in names:
        parts = items.select("item_id", F.coalesce("question", F.lit("")).alias("q"), F.coalesce(
            F.col("answer") if "answer" in names else F.lit(""), F.lit("")).alias("a"))
    else:
        parts = items.select("item_id", F.coalesce("text", F.lit("")).alias("q"),
                             F.lit(None).cast("string").alias("a"))
    size = parts.agg(
        F.count("*").alias("n"), F.sum(F.length("q") + F.length(F.coalesce("a", F.lit(""))))
        .alias("chars"), F.max(F.length("q")).alias("longest"),
    ).first()
    blocks = max(1, -(-size["n"] // (MAX_ITEMS // 2)), -(-(size["chars"] or 0) // (MAX_CHARS // 2)))
    place = F.pmod(F.xxhash64("item_id", "q"), F.lit(blocks))
    for k in range(blocks):
        rows = (parts.filter(place == k) if blocks > 1 else parts).collect()
        yield Index([
            (r["item_id"], *((r["q"], r["a"]) if r["a"] is not None else parts_of(r["q"])))
            for r in rows
        ])


def contaminated(
    docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP
) -> DataFrame:
    """A row for every document and item that it holds."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for index in item_blocks(items):
        found = texts.mapInArrow(
            lambda batches, index=index: _found(batches, index, threshold, overlap),
            f"doc_id long, {MATCH}",
        )
        out = found if out is None else out.unionByName(found)
    return out


def without_contaminated(
    docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP
) -> DataFrame:
    """The documents that hold no item, with all their columns and without a shuffle."""
    for index in item_blocks(items):
        docs = docs.mapInArrow(
            lambda batches, index=index: _clean(batches, index, threshold, overlap), docs.schema
        )
    return docs
