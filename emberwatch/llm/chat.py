"""Chat formatting with Spark expressions: sorted turns, merged roles, a reversible template.

A conversation's turns are collected as structs and sorted; adjacent turns of one role share a header,
with a separator between their texts. The characters that open a control string are
escaped inside texts and roles, so no text can imitate one and each text is read back as it was.

Template: ``<|role|>``, the texts with ``<|and|>`` between them, ``<|end|>``. Loss spans are code
point ranges, one for each assistant text.

Null text and null role are empty. Turns order by number, then role, then text, with nulls first, so
ties have one result; repeated rows are repeated turns. A null ``conv_id`` is a
conversation of its own. An empty table gives no rows. Other columns are not read. A conversation is
one output row, so its size is bounded by what a row can hold, not by the group's task alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSISTANT = "assistant"
OPEN, CLOSE, AND, END = "<|", "|>", "<|and|>", "<|end|>"
# What is escaped, and its escape; every backslash left in the output starts one of these.
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"), (">", "\\g"))


def escape(text: Column) -> Column:
    for raw, safe in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def format_conversations(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``formatted`` and ``loss_spans`` from (conv_id, turn, role, text)."""
    turn = F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    talks = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def role_at(i: Column) -> Column:
        return F.get("turns", i)["role"]

    pieces = F.transform("turns", lambda t, i: F.struct(
        F.when((i > 0) & (role_at(i - 1) == t["role"]), F.lit(AND)).otherwise(
            F.concat(F.lit(OPEN), escape(t["role"]), F.lit(CLOSE))).alias("head"),
        escape(t["text"]).alias("body"),
        F.when(F.coalesce(role_at(i + 1) == t["role"], F.lit(False)), F.lit("")).otherwise(
            F.lit(END)).alias("tail"),
        (t["role"] == ASSISTANT).alias("loss"),
    ))
    talks = talks.select("conv_id", pieces.alias("pieces"))
    ends = F.aggregate(
        "pieces",
        F.struct(F.lit(0).alias("at"),
                 F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["head"]) + F.length(p["body"]) + F.length(p["tail"]))
            .alias("at"),
            F.when(p["loss"], F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + F.length(p["head"])).alias("start"),
                (acc["at"] + F.length(p["head"]) + F.length(p["body"])).alias("end"),
            )))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    formatted = F.array_join(
        F.transform("pieces", lambda p: F.concat(p["head"], p["body"], p["tail"])), ""
    )
    return talks.select("conv_id", formatted.alias("formatted"), ends.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation."""
    groups = F.filter(F.split(formatted, "<\\|end\\|>"), lambda g: g != "")

    def close(g: Column) -> Column:
        return F.position(F.lit(CLOSE), g)

    return F.flatten(F.transform(groups, lambda g: F.transform(
        F.split(F.substr(g, close(g) + len(CLOSE)), "<\\|and\\|>", -1),
        lambda x: F.struct(
            unescape(F.substr(g, F.lit(len(OPEN) + 1), close(g) - len(OPEN) - 1)).alias("role"),
            unescape(x).alias("text"),
        ),
    )))


def read_loss(formatted: Column, loss_spans: Column) -> Column:
    """Texts under the loss mask."""
    return F.transform(loss_spans, lambda s: unescape(
        F.substr(formatted, s["start"] + 1, s["end"] - s["start"])
    ))


def describe(formatted: DataFrame) -> DataFrame:
    """The contract's digests, read back from the formatted output."""
    read = formatted.select(
        "conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"),
        F.array_join(read_loss(F.col("formatted"), F.col("loss_spans")), "").alias("loss"),
    )
    said = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_escape(x: str) -> str:
    for raw, safe in ESCAPES:
        x = f"replace({x}, '{raw}', '{safe}')"
    return x


SQL = f"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
placed as (
  select *, lag(role) over w as before, lead(role) over w as after from rows
  window w as (partition by conv_id order by turn nulls first, role, text))
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), ''
              order by turn nulls first, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = '{ASSISTANT}'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text)
              filter (role = '{ASSISTANT}'), '')) as loss_sha256,
       sum(length({_sql_escape('text')})
           + case when before = role then {len(AND)}
                  else {len(OPEN) + len(CLOSE)} + length({_sql_escape('role')}) end
           + case when after = role then 0 else {len(END)} end)::bigint as formatted_chars
from placed group by conv_id
"""
