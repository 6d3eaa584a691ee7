"""A Merkle manifest of a dataset: leaf, proof and verification of every document.

Each language is a tree over its leaves in ascending ``doc_id``; while it has several nodes, every run of
FAN consecutive ones (the last may be shorter, even one) becomes its parent. The trees' roots,
ordered by language, are the leaves of one more tree, whose root is that of the dataset.

Trees are cut in superblocks of FAN^LEVELS consecutive nodes. Going up, the superblocks of a tier
are reduced, each in a task, to the nodes of the next tier, until one node is left. Going down,
nodes and required outer nodes (the siblings on the way from the superblock's root to the dataset's)
are cogrouped by superblock; one task finishes the local reduction, joins the local siblings to the
outer ones as proofs and folds them. A group holds at most FAN^LEVELS nodes whatever the size of a
language, and there is a tier for each factor of FAN^LEVELS, so a few tiers do for any table.

Positions come from one range shuffle by (tree, doc_id): rows are numbered inside their sorted part
and the parts' counts give the offsets, so no task sees a whole language.

A null in any column is a ``-`` in the leaf; empty text is a value of length zero. Null languages are one tree,
the first; null ids come first in theirs and are never tampered with. Rows of equal id are ordered
by their leaves; repeated rows are leaves each, with proofs of their own. Text of any length is
digested by the expression engine. Columns other than those of documents do not matter and may
have any name. An empty table has no rows.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.llm.common import stored

FAN, LEVELS = 8, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

# A path is the levels from a node up to the root, joined by "/": the node's place in its run, one digit,
# and the run's other digests from left to right.
_NODE = "tree string, pos long, n long, node string"


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(text: Column) -> Column:
    """The digest of a row's columns, each with its length, so that no two rows share an input."""
    values = [F.col(name).cast("string") for name in FIELDS[:-1]] + [text]
    sized = [F.concat(F.octet_length(v).cast("string"), F.lit(":"), v) for v in values]
    return F.sha2(F.concat(*[F.coalesce(s, F.lit("-")) for s in sized]), 256)


def lower_some() -> Column:
    """Tampering: A-Z of the text lower-cased where 3 divides the id's checksum."""
    text = F.col("text")
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return F.when(hit, F.translate(text, string.ascii_uppercase, string.ascii_lowercase)).otherwise(text)


def placed(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Stored rows with ``pos``, the number inside their ``tree``, and ``n``, the tree's size."""
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            local = np.empty(batch.num_rows, np.int64)
            for i, tree in enumerate(batch.column("tree").to_pylist()):
                if tree != last:
                    last, seen = tree, 0
                local[i] = seen
                seen += 1
            yield batch.append_column("local", pa.array(local))

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    # The part number is attached before the rows reach Python, and they keep their order there.
    sorted_ = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    parted = sorted_.withColumn("part", F.spark_partition_id())
    numbered = stored(parted.mapInArrow(number, f"{shape}, part int, local long"), name)
    counts = numbered.groupBy("tree", "part").agg(F.count("*").alias("own"))
    whole = Window.partitionBy("tree")
    counts = counts.select(
        "tree", "part", F.sum("own").over(whole).alias("n"),
        (F.sum("own").over(whole.orderBy("part")) - F.col("own")).alias("before"),
    )
    found = numbered.join(counts, ["tree", "part"])
    return stored(
        found.withColumn("pos", F.col("before") + F.col("local")).drop("part", "local", "before"),
        f"{name}-placed",
    )


def local_levels(nodes: list[str], n: int, levels: int) -> list[list[str]]:
    """A superblock of a tree of ``n`` nodes, level by level from its nodes to its root.

    One that is all of its tree ends when one node is left; others have ``levels`` levels above
    their nodes however short they are.
    """
    made = [nodes]
    while len(made[-1]) > 1 or (n > FAN**levels and len(made) <= levels):
        below = made[-1]
        made.append([_hash("".join(below[i : i + FAN])) for i in range(0, len(below), FAN)])
    return made


def local_paths(levels: list[list[str]]) -> list[str]:
    """The path of every node of the lowest level up to the superblock's root."""
    paths = [""] * len(levels[-1])
    for below in reversed(levels[:-1]):
        made = []
        for i, _ in enumerate(below):
            at, first = i % FAN, i - i % FAN
            others = below[first:i] + below[i + 1 : first + FAN]
            above = paths[i // FAN]
            made.append(f"{at}{''.join(others)}" + (f"/{above}" if above else ""))
        paths = made
    return paths


def fold(node: str, path: str) -> str:
    """The root that a node and its path lead to."""
    width = 64
    for level in path.split("/") if path else []:
        cut = 1 + int(level[0]) * width
        node = _hash(level[1:cut] + node + level[cut:])
    return node


def proof_digest(path: str) -> str:
    """The digest of a path's siblings."""
    return _hash("".join(level[1:] for level in path.split("/")))


def _reduced(key: tuple, rows: pd.DataFrame, levels: int) -> pd.DataFrame:
    rows = rows.sort_values("pos")
    n = int(rows["n"].iloc[0])
    root = local_levels(rows["node"].tolist(), n, levels)[-1][0]
    above = -(-n // FAN**levels)
    return pd.DataFrame({"tree": [key[0]], "pos": [key[1]], "n": [above], "node": [root]})


def _descended(rows: pd.DataFrame, outer: pd.DataFrame, levels: int) -> pd.DataFrame:
    """Paths of a superblock's nodes: their own up to its root, then the outer one."""
    if rows.empty:
        return pd.DataFrame({"tree": [], "pos": [], "path": [], "subroot": [], "root": []})
    rows = rows.sort_values("pos")
    above = outer["path"].iloc[0]
    made = local_levels(rows["node"].tolist(), int(rows["n"].iloc[0]), levels)
    paths = ["/".join(p for p in (own, above) if p) for own in local_paths(made)]
    return pd.DataFrame({
        "tree": rows["tree"].tolist(), "pos": rows["pos"].tolist(), "path": paths,
        "subroot": outer["subroot"].iloc[0], "root": outer["root"].iloc[0],
    })


def _proved(rows: pd.DataFrame, outer: pd.DataFrame, levels: int) -> pd.DataFrame:
    """Proof and folded root of a superblock's leaves."""
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    if rows.empty:
        return pd.DataFrame({name: [] for name in names})
    rows = rows.sort_values("pos")
    found = _descended(rows, outer, levels)
    claimed = rows["claimed"].where(rows["claimed"].notna(), rows["node"])
    folded = [fold(c, p) for c, p in zip(claimed, found["path"])]
    return pd.DataFrame({
        "doc_id": rows["doc_id"].to_numpy(), "leaf": rows["node"].to_numpy(),
        "subroot": found["subroot"].to_numpy(), "root": found["root"].to_numpy(),
        "proof_sha256": [proof_digest(p) for p in found["path"]], "folded_root": folded,
        "verified": [a == b for a, b in zip(folded, found["root"])],
    })


def _blocked(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("pos", levels * (FAN.bit_length() - 1)))


def tiers_of(nodes: DataFrame, name: str, levels: int) -> list[DataFrame]:
    """The nodes of every tier, from the given ones to one node a tree."""
    tiers = [nodes.select("tree", "pos", "n", "node")]
    largest = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        up = _blocked(tiers[-1], levels).groupBy("tree", "block").applyInPandas(
            lambda key, rows: _reduced(key, rows, levels), _NODE
        )
        tiers.append(stored(up, name))
        largest = -(-largest // FAN**levels)
        if largest <= 1:
            return tiers


def descend(
    tiers: list[DataFrame], paths: DataFrame, name: str, levels: int, stop: int = 0
) -> DataFrame:
    """Paths of the nodes of tier ``stop``, from those of the one node a tree ends in."""
    for nodes in reversed(tiers[stop:-1]):
        outer = paths.withColumnRenamed("pos", "block")
        paths = stored(
            _blocked(nodes, levels).groupBy("tree", "block").cogroup(outer.groupBy("tree", "block"))
            .applyInPandas(
                lambda own, above: _descended(own, above, levels),
                "tree string, pos long, path string, subroot string, root string",
            ), name,
        )
    return paths


def audit(
    docs: DataFrame, claim: Callable[[], Column] | None = None, levels: int = LEVELS
) -> DataFrame:
    """Leaf, roots and proof of every document, and what its proof leads to for the claimed text.

    ``claim`` makes the text to verify out of the document's columns; without it the document's own is
    verified. ``verified`` says whether leaf and proof lead to the root.
    """
    claimed = leaf_of(claim() if claim else F.col("text"))
    # Every language gets a name that sorts like it; the null one comes first.
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    node = leaf_of(F.col("text"))
    leaves = stored(docs.select(
        tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), node.alias("node"),
        F.nullif(claimed, node).alias("claimed"),
    ), "merkle-leaves")
    leaves = placed(leaves, ["doc_id", "node"], "merkle-order")
    tiers = tiers_of(leaves, "merkle-tier", levels)
    subroots = tiers[-1].select(F.lit("").alias("tree"), F.col("tree").alias("own"), "node")
    subroots = placed(subroots, ["own"], "merkle-subroots")
    tops = tiers_of(subroots, "merkle-top", levels)
    start = tops[-1].select("tree", "pos", F.lit("").alias("path"), F.lit("").alias("subroot"),
                            F.col("node").alias("root"))
    above = descend(tops, start, "merkle-top-paths", levels)
    # The path of a language's root goes on below it.
    above = above.select("pos", "path", "root").join(
        subroots.select("pos", F.col("own").alias("tree"), F.col("node").alias("subroot")), "pos"
    ).select("tree", F.lit(0).cast("long").alias("pos"), "path", "subroot", "root")
    outer = descend(tiers, stored(above, "merkle-outer"), "merkle-paths", levels, 1)
    outer = outer.withColumnRenamed("pos", "block")
    return (
        _blocked(leaves, levels).groupBy("tree", "block").cogroup(outer.groupBy("tree", "block"))
        .applyInPandas(
            lambda own, above: _proved(own, above, levels),
            "doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
            "folded_root string, verified boolean",
        )
    )


_LETTERS = f"'{string.ascii_uppercase}', '{string.ascii_lowercase}'"
# Levels the SQL writes out for a tree; enough for FAN^SQL_LEVELS documents of a language.
SQL_LEVELS = 8


def _leaf_sql(text: str) -> str:
    parts = [f"coalesce(strlen({v}::varchar) || ':' || {v}, '-')" for v in (*FIELDS[:-1], text)]
    return f"sha256({' || '.join(parts)})"


def _levels_sql(name: str, first: str) -> str:
    """Runs ``r`` and sizes of every level of the trees that ``first`` (tree, pos, node) starts."""
    made = [f"{name}0 as (select *, count(*) over (partition by tree) as n from {first})"]
    for k in range(SQL_LEVELS):
        made.append(f"{name}r{k} as (select tree, pos // {FAN} as run, list(node order by pos) as r, "
                    f"any_value(n) as n from {name}{k} group by tree, run)")
        made.append(f"{name}{k + 1} as (select tree, run as pos, case when n > 1 then "
                    f"sha256(array_to_string(r, '')) else r[1] end as node, "
                    f"count(*) over (partition by tree) as n from {name}r{k})")
    return ",\n".join(made)


def _climb_sql(name: str, first: str) -> str:
    """Siblings gathered and claims folded along ``name``'s levels, from (id, tree, pos, sib, fold)."""
    made = [f"{name}c0 as (select * from {first})"]
    for k in range(SQL_LEVELS):
        left = f"array_to_string(r[1:c.pos % {FAN}], '')"
        right = f"array_to_string(r[c.pos % {FAN} + 2:], '')"
        made.append(
            f"{name}c{k + 1} as (select c.id, c.tree, c.pos // {FAN} as pos, "
            f"case when n > 1 then sib || {left} || {right} else sib end as sib, "
            f"case when n > 1 then sha256({left} || fold || {right}) else fold end as fold "
            f"from {name}c{k} c join {name}r{k} r on c.tree = r.tree and c.pos // {FAN} = r.run)")
    return ",\n".join(made)


_CRC = """crc_table as (select list(c order by i) as crc_of from (
    select i, list_reduce(list_prepend(i::ubigint, list_transform(range(8), lambda k: k::ubigint)), lambda c, k:
      case when c % 2 = 1 then xor(c // 2, 3988292384::ubigint) else c // 2 end) as c
    from unnest(range(256)) as u(i)))"""

SQL = f"""
with {_CRC},
docs as (select row_number() over () as id, doc_id, source, lang, n_chars, text,
                coalesce('=' || lang, '') as tree, xor(4294967295::ubigint, list_reduce(
                  list_prepend(4294967295::ubigint, list_transform(string_split(doc_id::varchar, ''),
                    lambda x: ascii(x)::ubigint)), lambda c, b:
                  xor(c // 256, crc_of[(xor(c, b) % 256)::bigint + 1]))) as crc
         from documents, crc_table),
hashed as (select id, doc_id, tree, {_leaf_sql('text')} as node, case when crc % 3 = 0 then
                  {_leaf_sql(f"translate(text, {_LETTERS})")} end as claimed from docs),
leaves as (select *, row_number() over (partition by tree order by doc_id, node) - 1 as pos from hashed),
{_levels_sql("a", "(select tree, pos, node from leaves)")},
subroots as (select tree as own, '' as tree, row_number() over (order by tree) - 1 as pos, node
             from a{SQL_LEVELS}),
{_levels_sql("b", "(select tree, pos, node from subroots)")},
{_climb_sql("a", "(select id, tree, pos, '' as sib, coalesce(claimed, node) as fold from leaves)")},
crossing as (select id, s.tree, s.pos, sib, fold from ac{SQL_LEVELS} c join subroots s on c.tree = s.own),
{_climb_sql("b", "crossing")}
select l.doc_id, l.node as leaf, s.node as subroot, r.node as root, sha256(sib) as proof_sha256,
       fold as folded_root, fold = r.node as verified
from leaves l join subroots s on l.tree = s.own join bc{SQL_LEVELS} c on l.id = c.id, b{SQL_LEVELS} r
"""
