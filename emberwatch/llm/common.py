"""Small helpers of the text operators: tables, stored steps and match positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.session import scratch_path

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """The rows written to the shared folder and read back.

    What follows reads them from there, so a lost executor repeats a scan and not the work.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# A key is hot if one in this many rows has it, so no more than this many keys are.
HOT_SHARE = 1000


def join_facts(rows: DataFrame, facts: DataFrame, key: str, copies: str = "copies") -> DataFrame:
    """Each row with the facts of its key, for stored rows and facts of one row per key.

    ``copies`` says how many rows a key has. Keys that hold a thousandth of the rows or more, at most a
    thousand of them, are answered from a broadcast; only rows of other keys meet by key.
    """
    total = facts.agg(F.coalesce(F.sum(copies), F.lit(0))).first()[0]
    is_hot = F.col(copies) * HOT_SHARE >= F.lit(total)
    hot = facts.filter(is_hot)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(cold.join(facts.filter(~is_hot), key))


def match_starts(text: Column, pattern: str, matches: Column) -> Column:
    """0-based code point starts of the matches that ``regexp_extract_all`` found.

    ``split`` walks the same matches, so the i-th start is the length of the gaps up to it plus
    the length of the matches before it.
    """
    gaps = F.split(text, pattern, -1)
    return F.aggregate(
        F.arrays_zip(matches.alias("m"), F.slice(gaps, F.lit(1), F.size(matches)).alias("g")),
        F.struct(
            F.lit(0).cast("int").alias("at"),
            F.array().cast("array<int>").alias("starts"),
        ),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["g"]) + F.length(x["m"])).alias("at"),
            F.concat(acc["starts"], F.array(acc["at"] + F.length(x["g"]))).alias("starts"),
        ),
        lambda acc: acc["starts"],
    )


# A span found in a text: kind, places in code points (end exclusive) and the matched text.
SPAN = "array<struct<kind:string,rank:int,start:int,end:int,found:string>>"


def spans(text: Column, matches: Column, kind: str, rank: int, pattern: str, keep) -> Column:
    """Spans of the matches that ``keep`` accepts; positions are worked out only where needed."""
    placed = F.transform(
        F.arrays_zip(matches.alias("m"), match_starts(text, pattern, matches).alias("s")),
        lambda x: F.struct(
            F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), x["s"].alias("start"),
            (x["s"] + F.length(x["m"])).alias("end"), x["m"].alias("found"),
        ),
    )
    wanted = F.exists(matches, keep)
    return F.when(wanted, F.filter(placed, lambda x: keep(x["found"]))).otherwise(
        F.array().cast(SPAN)
    )


def span_text(found: Column) -> Column:
    """kind:start:end of every span, by start, then rank of the kind, comma-joined."""
    ordered = F.sort_array(F.transform(found, lambda x: F.struct(
        x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"),
        x["kind"].alias("kind"),
    )))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string")
    )), ",")


def masked(text: Column, hidden: Column, mark: str) -> Column:
    """The text with ``mark`` in place of every hidden (start, end); overlaps share one mark."""
    ordered = F.sort_array(F.transform(hidden, lambda x: F.struct(x["start"], x["end"])))
    step = F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, x: F.struct(
            F.greatest(acc["at"], x["end"]).alias("at"),
            F.when(
                (x["start"] >= acc["at"]),
                F.concat(acc["out"], F.substr(text, acc["at"] + 1, x["start"] - acc["at"]),
                         F.lit(mark)),
            ).otherwise(acc["out"]).alias("out"),
        ),
    )
    return F.concat(step["out"], F.substr(text, step["at"] + 1))
