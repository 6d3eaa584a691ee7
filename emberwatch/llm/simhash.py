"""SimHash near-duplicates: fingerprints, bit-sliced comparison and components.

Two 64-bit fingerprints that differ in at most two bits agree on two of four 16-bit blocks, so
pairs are looked for inside the six groups of equal block pairs; none is missed. Only groups of two
or more distinct fingerprints are compared. A group's fingerprints are held as vertical bit
planes; the planes of one query update 64 distances per word with carry-save counters, and a block
of candidates is given up once every distance is past the radius. A group larger than TILE is cut
in tiles whose pairs are compared in separate tasks.

A null text, like an empty one, has no words and fingerprint zero. Exact and near copies, and rows
that share a ``doc_id``, are linked like any other rows; a null ``doc_id`` takes part, and a
component of such rows alone has a null id. An empty table gives no rows. Columns other than
``doc_id`` and the text are left out of the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.common import stored

WORDS = 3
SEED = 42
RADIUS = 2
TILE = 2048
CHUNK = 20_000

_BLOCK_PAIRS = list(combinations(range(4), 2))


def shingle_hashes(text: str | None, words: int) -> list[int]:
    """XXH64 of the word shingles, in order; fewer words are one shingle, no word is none."""
    import xxhash

    # Lowers A-Z alone and splits at ASCII white space, as the bytes of UTF-8.
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return []
    line = b" ".join(found)
    if len(found) <= words:
        return [xxhash.xxh64_intdigest(line, SEED)]
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    firsts = np.concatenate([[0], ends[:-1] + 1])[: len(found) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip(firsts, ends[words - 1 :].tolist())]


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Unsigned 64-bit SimHash of the word shingles, by majority of their XXH64 bits."""
    hashes = shingle_hashes(text, words)
    if not hashes:
        return 0
    total = np.zeros(64, np.int64)
    for low in range(0, len(hashes), CHUNK):
        part = np.array(hashes[low : low + CHUNK], ">u8").view(np.uint8)
        total += np.unpackbits(part.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"),
            "print": _signed([fingerprint(t.as_py()) for t in texts]),
        })


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for made in _fingerprints([batch]):
            yield pa.RecordBatch.from_arrays(
                [batch.column("match"), *made.columns], ["match", *made.schema.names]
            )


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the fingerprint as a signed 64-bit ``print``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _fingerprints, "doc_id long, print long"
    )


def link_masks(planes: np.ndarray, queries: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Candidate bits within the radius of each query.

    planes: (64, groups, words) bit planes of the candidates; queries: (64, queries, groups) the
    query's own bit of each plane, as all ones or zeros. Distances up to 2 need two counter bits
    and one that stays set once a third is carried.
    """
    assert radius == 2
    shape = (queries.shape[1], *planes.shape[1:])
    ones, twos = np.zeros(shape, np.uint64), np.zeros(shape, np.uint64)
    past = np.zeros(shape, np.uint64)
    for k in range(64):
        differs = planes[k][None] ^ queries[k][:, :, None]
        carry = ones & differs
        ones ^= differs
        past |= (twos & ones) | (twos & carry)
        twos |= carry
        if k % 16 == 15 and bool((past == ~np.uint64(0)).all()):
            break
    return ~past


def spans_of(first: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of several ranges in a row, and where each range starts among them."""
    starts = np.cumsum(lengths) - lengths
    return np.arange(lengths.sum()) + np.repeat(first - starts, lengths), starts


def _bit_planes(prints: np.ndarray) -> np.ndarray:
    """(groups, members) fingerprints as (64, groups, words) planes; members a multiple of 64."""
    groups, members = prints.shape
    planes = np.empty((64, groups, members // 64), np.uint64)
    for k in range(64):
        bits = ((prints >> np.uint64(k)) & np.uint64(1)).astype(np.uint8)
        planes[k] = np.packbits(bits, axis=1, bitorder="little").view("<u8")
    return planes


def _group_links(prints: np.ndarray, sizes: np.ndarray, sides: np.ndarray | None):
    """Linked pairs (group, member, member) of padded groups; across the sides if given."""
    groups, members = prints.shape
    planes = _bit_planes(prints)
    place = np.arange(members)
    valid = np.packbits(place[None] < sizes[:, None], axis=1, bitorder="little").view("<u8")
    step = max(1, 2_000_000 // max(1, groups * members // 64) // 8)
    for low in range(0, int(sizes.max()), step):
        asked = prints[:, low : low + step].T
        bits = [(asked >> np.uint64(k)) & np.uint64(1) for k in range(64)]
        queries = np.stack([np.uint64(0) - b for b in bits])
        near = link_masks(planes, queries) & valid[None]
        flags = np.unpackbits(near.view(np.uint8), axis=2, bitorder="little").astype(bool)
        q, g, m = np.nonzero(flags)
        keep = (q + low < sizes[g]) & (q + low < m)
        if sides is not None:
            keep &= sides[g, np.minimum(q + low, members - 1)] != sides[g, m]
        yield g[keep], q[keep] + low, m[keep]


def roots(size: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest member of each member's component."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[left], label[right])
        following = label.copy()
        np.minimum.at(following, left, low)
        np.minimum.at(following, right, low)
        np.minimum.at(following, label[left], low)
        np.minimum.at(following, label[right], low)
        following = following[following]
        if (following == label).all():
            return label
        label = following


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted rows as (group start flags, prints, sides), cut between groups only."""
    kept: list[np.ndarray] = []
    for batch in batches:
        rows = np.stack([batch.column(n).to_numpy() for n in ("slot", "key", "tile", "print",
                                                              "side")])
        kept.append(rows)
        rows = np.concatenate(kept, axis=1)
        same = (rows[:3, -1:] == rows[:3]).all(axis=0)
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield rows[:, :cut]
        kept = [rows[:, cut:]]
    if kept and kept[0].shape[1]:
        yield np.concatenate(kept, axis=1)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _runs(batches):
        change = (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)
        first = np.concatenate([[0], np.flatnonzero(change) + 1])
        sizes = np.diff(np.append(first, rows.shape[1]))
        prints, sides = rows[3].view(np.uint64), rows[4]
        # Groups of like size are compared together, each padded to whole words.
        like = np.where(sizes < 64, 1 << np.ceil(np.log2(sizes)).astype(int), (sizes + 63) // 64 * 64)
        left, right = [], []
        for size in np.unique(like[sizes > 1]):
            chosen = np.flatnonzero((like == size) & (sizes > 1))
            w = max(64, int(size))
            for low in range(0, len(chosen), max(1, 262_144 // w)):
                some = chosen[low : low + max(1, 262_144 // w)]
                at = first[some][:, None] + np.minimum(np.arange(w), sizes[some][:, None] - 1)
                tiled = rows[2, first[some]] >= 0
                across = np.where(tiled[:, None], sides[at], np.arange(w)[None])
                for g, a, b in _group_links(prints[at], sizes[some], across):
                    left.append(at[g, a])
                    right.append(at[g, b])
        if not left:
            continue
        a, b = np.concatenate(left), np.concatenate(right)
        label = roots(rows.shape[1], a, b)
        member = np.unique(np.concatenate([a, b]))
        member = member[label[member] != member]
        yield pa.RecordBatch.from_pydict({
            "a": pa.array(rows[3][member]), "b": pa.array(rows[3][label[member]]),
        })


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints, enough to connect all that link.

    Every group gives a star for each of its components, so a group of n near copies gives n - 1
    edges at most and loses no component.
    """
    block = [F.shiftrightunsigned("print", 48 - 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    keyed = prints.select("print", F.explode(F.array(*[
        F.struct(
            F.lit(n).cast("long").alias("slot"),
            (block[i] * F.lit(1 << 16) + block[j]).alias("key"),
        ) for n, (i, j) in enumerate(_BLOCK_PAIRS)
    ])).alias("x")).select("x.slot", "x.key", "print")
    sizes = keyed.groupBy("slot", "key").agg(F.count("*").alias("n")).filter("n > 1")
    sized = keyed.join(sizes, ["slot", "key"])
    tiles = F.ceil(F.col("n") / F.lit(TILE)).cast("long")
    side = F.pmod(F.xxhash64("print"), tiles)
    # A group of one tile is compared within itself; of more, tile by tile: (i, i) within,
    # (i, j) across.
    spread = sized.withColumn("side", side).withColumn("_tiles", tiles)
    other = F.sequence(F.lit(0).cast("long"), F.col("_tiles") - 1)
    pair = F.transform(other, lambda o: F.when(
        F.col("_tiles") == 1, F.lit(-1).cast("long")
    ).when(o == F.col("side"), -2 - o).otherwise(
        F.least(o, F.col("side")) * F.col("_tiles") + F.greatest(o, F.col("side"))
    ))
    spread = spread.select("slot", "key", F.explode(pair).alias("tile"), "print", "side")
    return (
        spread.repartition("slot", "key", "tile").sortWithinPartitions("slot", "key", "tile")
        .mapInArrow(_linked, "a long, b long").distinct()
    )


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node`` and the smallest node it is connected to, for nodes with an edge.

    Large-star and small-star rounds; each round's edges are written to the shared folder, so the
    plan stays short and a lost executor repeats one round.
    """
    edges = stored(edges.select("a", "b"), name)
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), "m")
        large = stored(large.filter("a <> m").distinct(), name)
        down = large.select(F.greatest("a", "m").alias("a"), F.least("a", "m").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), "m").filter("a <> m")
        small = stored(small.union(least.select("a", "m")).distinct()
                       .select("a", F.col("m").alias("b")), name)
        # Done once no node has two roots and no root is a member.
        doubled = small.groupBy("a").count().filter("count > 1").select("a").limit(1)
        chained = small.join(small.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
        edges = small
        if doubled.union(chained.select("a").limit(1)).isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def rooted(prints: DataFrame) -> DataFrame:
    """``print``, ``root`` and ``component_id`` of every distinct fingerprint of (doc_id, print)."""
    distinct = stored(
        prints.groupBy("print").agg(F.min("doc_id").alias("least")), "distinct-prints"
    )
    joined = components(links(distinct.select("print")))
    named = distinct.join(joined.withColumnRenamed("node", "print"), "print", "left").select(
        "print", "least", F.coalesce("root", "print").alias("root")
    )
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return stored(named.join(least, "root").select("print", "root", "component_id"), "rooted")


def clusters(docs: DataFrame, fingerprinted: DataFrame | None = None) -> DataFrame:
    """``doc_id``, ``print``, ``root`` and ``component_id`` of every row.

    ``root`` is a fingerprint of the component, ``component_id`` its smallest ``doc_id``.
    """
    prints = fingerprinted if fingerprinted is not None else stored(fingerprints(docs), "prints")
    return prints.join(rooted(prints), "print").select("doc_id", "print", "root", "component_id")


def match_of() -> Column:
    """A digest of a row's id and text."""
    return F.sha2(F.concat_ws(
        "\x00", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")),
        F.coalesce("text", F.lit("")),
    ), 256)


def keep_first(docs: DataFrame, prints: DataFrame, roots: DataFrame) -> DataFrame:
    """The first document of every ``root``; prints with ``match``, ``doc_id`` and ``print``."""
    each = prints.groupBy("match", "doc_id", "print").agg(F.count("*").alias("copies"))
    place = F.struct(F.isnull("doc_id").alias("last"), "doc_id", "match", "copies")
    # Rows of one fingerprint are cut to one before they meet the others of the component.
    first = each.groupBy("print").agg(F.min(place).alias("first"))
    winners = stored(
        first.join(roots, "print").groupBy("root")
        .agg(F.min("first").alias("first")).select("first.match", "first.copies"),
        "kept-documents",
    )
    packed = docs.select(F.struct("*").alias("row"), match_of().alias("match"))
    kept = packed.join(winners, "match")
    if winners.filter("copies > 1").isEmpty():
        return kept.select("row.*")
    once = kept.filter("copies > 1").dropDuplicates(["match"])
    return kept.filter("copies = 1").unionByName(once).select("row.*")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of every component, with its own columns: that with the smallest ``doc_id``.

    Null ids come last, equal ones are told apart by a digest of id and text, and of repeated rows
    one stays. The text itself is shuffled once.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", match_of().alias("match"))
    prints = stored(rows.mapInArrow(_matched, "match string, doc_id long, print long"), "prints")
    return keep_first(docs, prints, rooted(prints.select("doc_id", "print")))


def hexadecimal(prints: str) -> Column:
    return F.lower(F.lpad(F.hex(prints), 16, "0"))
