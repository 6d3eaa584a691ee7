"""Token ids of whole texts, encoded once per distinct word and task.

The tokenizer never merges across white space, so a text's ids are its words' ids in order; a
long corpus repeats its words, and only new ones reach the tokenizers library.
"""

from __future__ import annotations

import os
import string
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 1
# Bounds on what one Python worker remembers, and on the text it expands at once.
MEMO_WORDS = 400_000
MEMO_IDS = 4_000_000
SLICE_BYTES = 5_000_000
LINE_WORDS = 200

# Between a letter and these marks the tokenizer always cuts.
WORD_END = "([A-Za-z])([,.])"

_encoders: dict[str, "WordEncoder"] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of texts by a word-level tokenizer file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = self._plain()
        self._forget()

    def _plain(self) -> bool:
        """Whether words of ASCII letters are lowered and reach the model whole."""
        letters = string.ascii_letters
        lowered = self.tokenizer.normalizer.normalize_str(letters)
        parts = self.tokenizer.pre_tokenizer.pre_tokenize_str(lowered)
        return lowered == letters.lower() and [p for p, _ in parts] == [lowered]

    def _forget(self) -> None:
        self.words = pa.array([], pa.string())
        self.pool = np.empty(1 << 16, np.uint32)
        self.used = 0
        self.first = np.empty(1 << 14, np.int64)
        self.count = np.empty(1 << 14, np.int64)

    def _learn(self, words: list[str]) -> np.ndarray:
        """Encode new words; their slots."""
        whole = np.fromiter(
            (not (self.plain and w.isascii() and w.isalpha()) for w in words), bool, len(words)
        )
        slots = np.empty(len(words), np.int64)
        known = len(self.words)
        plain = [w for w, full in zip(words, whole.tolist()) if not full]
        other = [w for w, full in zip(words, whole.tolist()) if full]
        slots[~whole] = known + np.arange(len(plain))
        slots[whole] = known + len(plain) + np.arange(len(other))
        tokenize = self.tokenizer.model.tokenize
        ids = [[t.id for t in tokenize(w.lower())] for w in plain]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(counts.sum()))
        self._keep(flat, counts, known)
        self._keep(*self._joined(other), known + len(plain))
        self.words = pa.concat_arrays([self.words, pa.array(plain, pa.string()),
                                       pa.array(other, pa.string())])
        return slots

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words encoded as lines of many, and how many belong to each word."""
        lines = [words[i : i + LINE_WORDS] for i in range(0, len(words), LINE_WORDS)]
        flat, counts = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        encoded = self.tokenizer.encode_batch(list(map(" ".join, lines)), add_special_tokens=False)
        for line, e in zip(lines, encoded):
            ends = np.cumsum(np.fromiter(map(len, line), np.int64, len(line)) + 1)
            at = np.fromiter((o[0] for o in e.offsets), np.int64, len(e.ids))
            flat.append(np.array(e.ids, np.uint32))
            counts.append(np.bincount(np.searchsorted(ends, at, "right"), minlength=len(line)))
        return np.concatenate(flat), np.concatenate(counts)

    def _keep(self, flat: np.ndarray, counts: np.ndarray, known: int) -> None:
        self.pool = _room(self.pool, self.used + len(flat))
        self.first = _room(self.first, known + len(counts))
        self.count = _room(self.count, known + len(counts))
        self.pool[self.used : self.used + len(flat)] = flat
        self.first[known : known + len(counts)] = self.used + np.cumsum(counts) - counts
        self.count[known : known + len(counts)] = counts
        self.used += len(flat)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and where each text's ids start; null is empty."""
        if len(self.words) > MEMO_WORDS or self.used > MEMO_IDS:
            self._forget()
        texts = pc.fill_null(texts, "")
        if self.plain:
            texts = pc.replace_substring_regex(texts, WORD_END, r"\1 \2")
        split = pc.ascii_split_whitespace(texts)
        offsets = split.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        coded = split.flatten().dictionary_encode()
        found = pc.index_in(coded.dictionary, value_set=self.words)
        slots = pc.fill_null(found, -1).to_numpy().astype(np.int64)
        fresh = np.flatnonzero(slots < 0)
        if len(fresh):
            slots[fresh] = self._learn(coded.dictionary.take(pa.array(fresh)).to_pylist())
        at = slots[coded.indices.to_numpy()]
        counts = self.count[at]
        ends = np.concatenate([[0], np.cumsum(counts)])
        index = np.arange(ends[-1], dtype=np.int64)
        index += np.repeat(self.first[at] - ends[:-1], counts)
        return self.pool[index], ends[offsets]


def _room(array: np.ndarray, size: int) -> np.ndarray:
    if size <= len(array):
        return array
    grown = np.empty(max(size, 2 * len(array)), array.dtype)
    grown[: len(array)] = array
    return grown


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def text_slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about SLICE_BYTES of text; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // SLICE_BYTES
    cuts = np.flatnonzero(np.diff(group)) + 1
    bounds = [0, *cuts.tolist(), len(texts)]
    yield from zip(bounds[:-1], bounds[1:])


def encode_documents(batch: pa.RecordBatch, path: str, text: str = "text"):
    """Row range, ids with the end id of every document, and each document's first place."""
    texts = batch.column(text)
    for low, high in text_slices(texts):
        if low == high:
            continue
        ids, starts = encoder(path).encode(texts.slice(low, high - low))
        yield low, high, np.insert(ids, starts[1:], END_ID), starts + np.arange(high - low + 1)


def crc32(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
