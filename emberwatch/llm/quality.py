"""Quality rules with cutoffs whose false rejections are bounded on labelled documents.

Every rule compares a per-mille share of a document with a cutoff. Cutoffs come from labelled
documents held out for this, per stratum (language) and rule: going from lax to strict, a cutoff is
accepted while the exact binomial test rejects that good documents fall to it more often than the
rule's share of ALPHA; the first miss ends the rule. Levels are divided by the number of strata and
rules (Bonferroni), and the sequence within a rule needs no further correction. Among accepted
cutoffs the laxest that catches the most bad documents is used; a rule that catches none, or a
stratum with too few labels, has no cutoff. All stays in SQL expressions.

Null or empty text has no words and fails the base rule. A null language is a stratum of its own.
Labels without a document, or without a value, are left out; of a ``doc_id`` that occurs more often
every row is tested by itself. Without labels only the base rule decides. An empty table gives no
rows. Other columns are carried along unless they bear the name of a result column.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.common import stored

WINDOW = 8
MIN_WORDS = 20
ALPHA = 0.05
DELTA = 0.05
# Shares in thousandths, from lax to strict.
CUTOFFS = (500, 400, 300, 250, 200, 150, 100, 75, 50, 30, 20, 10)
RULES = ("symbols", "capitals", "marks", "repeats")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")

SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
MARKS = "!|"


def _occurrences(text: Column, characters: str) -> Column:
    bare = text
    for c in characters:
        bare = F.replace(bare, F.lit(c))
    return (F.length(text) - F.length(bare)).cast("long")


def _item(array: Column, at: Column) -> Column:
    return F.get(array, at.cast("int"))


def _repeated(windows: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more."""
    ordered = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    # The sorted array is bound once by the outer transform.
    starts = F.transform(F.array(ordered), lambda s: F.sort_array(F.transform(
        F.filter(s, lambda x, k: F.coalesce(_item(s, k - 1)["w"] == x["w"], F.lit(False))
                 | F.coalesce(_item(s, k + 1)["w"] == x["w"], F.lit(False))),
        lambda x: x["i"],
    )))[0]
    total = F.aggregate(
        starts,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, p: F.struct(
            p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n")
        ),
        lambda acc: acc["n"],
    )
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")
                  ).otherwise(total)


def features(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The base counts and the rules' shares of every document, by passes over the row itself."""
    whole = F.coalesce(F.col(text), F.lit(""))
    step = docs.select(
        *keep, whole.alias("_text"),
        F.filter(F.split(whole, SPACE), lambda w: w != "").alias("_words"),
    )
    hashes = F.transform("_words", lambda w: F.xxhash64(w))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    step = step.select(
        *keep, F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        _occurrences(F.col("_text"), SYMBOLS).alias("n_symbols"),
        _occurrences(F.col("_text"), MARKS).alias("_marks"),
        (F.length("_text") - F.length(F.regexp_replace("_text", "[A-Z]+", ""))).alias("_capitals"),
        lines.alias("_lines"), hashes.alias("_hashes"),
    )
    window = F.transform(
        F.sequence(F.lit(0), (F.col("n_words") - WINDOW).cast("int")),
        lambda i: F.xxhash64(*[_item(F.col("_hashes"), i + k) for k in range(WINDOW)]),
    )
    step = step.select(
        "*", F.when(F.col("n_words") >= WINDOW, window)
        .otherwise(F.array().cast("array<bigint>")).alias("_windows"),
    ).drop("_hashes")
    step = step.select(
        *keep, "n_words", "word_chars", "n_symbols", "_marks", "_capitals",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("_windows")).alias("n_repeat_words"),
    )

    def share(n: str, of: str) -> Column:
        return F.when(F.col(of) > 0, F.expr(f"1000 * {n} div {of}")).otherwise(F.lit(0))

    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > 30 * F.col("n_words")
    )
    return step.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        share("n_symbols", "word_chars").alias("share_symbols"),
        share("_capitals", "word_chars").alias("share_capitals"),
        share("_marks", "word_chars").alias("share_marks"),
        share("n_repeat_words", "n_words").alias("share_repeats"),
        # A filter that uses this column is not pushed below the measuring.
        F.monotonically_increasing_id().alias("_place"),
    )


def _log_factorial(n: Column) -> Column:
    """Natural logarithm of n!, by Stirling's series from 16 on."""
    x = n.cast("double")
    series = (
        x * F.log(x) - x + F.log(x * (2 * math.pi)) / 2
        + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    )
    return F.when(n < 16, F.log(F.factorial(F.least(n, F.lit(15)).cast("int")).cast("double"))
                  ).otherwise(series)


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) of n draws at ``rate``, for k below the mean.

    Terms fall from k down faster than geometrically, so the sum ends where they no longer count
    in double precision.
    """
    top = F.exp(
        _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)
        + k * math.log(rate) + (n - k) * math.log1p(-rate)
    )
    terms = F.least(k, (F.lit(200) + 20 * F.sqrt(k.cast("double"))).cast("long"))
    total = F.aggregate(
        F.sequence(F.lit(0).cast("long"), terms),
        F.struct(top.alias("term"), F.lit(0.0).alias("sum")),
        lambda acc, i: F.struct(
            (acc["term"] * (k - i) / (n - k + i + 1) * ((1 - rate) / rate)).alias("term"),
            (acc["sum"] + acc["term"]).alias("sum"),
        ),
        lambda acc: acc["sum"],
    )
    return F.when(k >= n * rate, F.lit(1.0)).otherwise(total)


def calibrate(
    measured: DataFrame, labels: DataFrame, stratum: str = "lang",
    alpha: float = ALPHA, delta: float = DELTA,
) -> DataFrame:
    """One row per stratum with a cutoff, or null, for every rule."""
    holdout = labels.filter("quality is not null").select("doc_id", "quality").join(
        measured.filter(~F.col("base_failed")), "doc_id"
    ).withColumn("_stratum", F.coalesce(F.col(stratum), F.lit("")))
    counts = [F.count_if(F.col("quality") == 1).alias("n")]
    for rule in RULES:
        for cut in CUTOFFS:
            hit = F.col(f"share_{rule}") >= cut
            counts.append(F.count_if(hit & (F.col("quality") == 1)).alias(f"g_{rule}_{cut}"))
            counts.append(F.count_if(hit & (F.col("quality") != 1)).alias(f"b_{rule}_{cut}"))
    strata = stored(holdout.groupBy("_stratum").agg(*counts), "quality-counts")
    level = F.lit(delta / len(RULES)) / F.greatest(F.lit(1), F.col("_strata"))
    strata = strata.crossJoin(strata.agg(F.count("*").alias("_strata")))
    chosen = []
    for rule in RULES:
        tested = F.array(*[F.struct(
            F.lit(cut).alias("cut"), F.col(f"b_{rule}_{cut}").alias("bad"),
            (binomial_tail(F.col(f"g_{rule}_{cut}"), F.col("n"), alpha / len(RULES)) <= level)
            .alias("passed"),
        ) for cut in CUTOFFS])
        accepted = F.aggregate(
            tested,
            F.struct(F.lit(True).alias("open"), F.lit(0).cast("long").alias("bad"),
                     F.lit(None).cast("int").alias("cut")),
            lambda acc, x: F.struct(
                (acc["open"] & x["passed"]).alias("open"),
                F.when(acc["open"] & x["passed"], F.greatest(acc["bad"], x["bad"]))
                .otherwise(acc["bad"]).alias("bad"),
                F.when(acc["open"] & x["passed"] & (x["bad"] > acc["bad"]), x["cut"])
                .otherwise(acc["cut"]).alias("cut"),
            ),
            lambda acc: acc["cut"],
        )
        chosen.append(accepted.alias(f"cut_{rule}"))
    return stored(strata.select("_stratum", *chosen), "quality-cutoffs")


def judge(measured: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """``kept`` for every measured row; the few cutoffs come from a stored table."""
    fired = F.lit(False)
    for rule in RULES:
        fired |= F.coalesce(F.col(f"share_{rule}") >= F.col(f"cut_{rule}"), F.lit(False))
    return (
        measured.withColumn("_stratum", F.coalesce(F.col(stratum), F.lit("")))
        .join(cutoffs, "_stratum", "left")
        .withColumn("kept", ~F.col("base_failed") & ~fired)
        .drop("_stratum", *[f"cut_{rule}" for rule in RULES])
    )


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts, shares and verdict of every document, measured once."""
    measured = stored(features(docs, keep=("doc_id", "lang")).drop("_place"), "quality-features")
    return judge(measured, calibrate(measured, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that no rule rejects, with their own columns.

    Only shares are stored for the cutoffs; the verdict is taken on the row itself, so no text
    is shuffled.
    """
    measured = stored(features(docs, keep=("doc_id", "lang")).drop("_place"), "quality-features")
    cutoffs = calibrate(measured, labels)
    packed = docs.select(F.struct("*").alias("_row"))
    packed = packed.select(
        "_row", F.col("_row.text").alias("text"), F.col("_row.lang").alias("lang")
    )
    judged = judge(features(packed, keep=("_row", "lang")), cutoffs)
    return judged.filter("kept and _place >= 0").select("_row.*")


SQL = f"""
with docs as (select row_number() over () as r, doc_id, coalesce(lang, '') as stratum,
                     coalesce(text, '') as t from documents),
split as (select *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as w,
                 list_filter(string_split(t, chr(10)),
                             lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from docs),
windows as (select r, unnest(range(1, len(w) - {WINDOW - 2})) as i, w from split
            where len(w) >= {WINDOW}),
named as (select r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') as x from windows),
twice as (select r, i from (select r, i, count(*) over (partition by r, x) as n from named)
          where n > 1),
covered as (select r, sum(least({WINDOW}, coalesce(i - before, {WINDOW}))) as n from
            (select r, i, lag(i) over (partition by r order by i) as before from twice) group by r),
base as (select s.r, doc_id, stratum, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
                length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols,
                length(regexp_replace(t, '[^A-Z]', '', 'g')) as capitals,
                length(regexp_replace(t, '[^!|]', '', 'g')) as marks,
                len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(n, 0) as n_repeat_words
         from split s left join covered c on s.r = c.r),
measured as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > 30 * n_words as base_failed,
                    case when word_chars > 0 then 1000 * n_symbols // word_chars else 0 end as symbols,
                    case when word_chars > 0 then 1000 * capitals // word_chars else 0 end as capital,
                    case when word_chars > 0 then 1000 * marks // word_chars else 0 end as mark,
                    case when n_words > 0 then 1000 * n_repeat_words // n_words else 0 end as repeats
             from base),
holdout as (select m.*, quality from measured m join labels using (doc_id)
            where quality is not null and not base_failed),
strata as (select stratum, count_if(quality = 1)::bigint as n, count(*) over () as strata
           from holdout group by stratum),
shares as (select stratum, quality, unnest(['symbols', 'capitals', 'marks', 'repeats']) as rule,
                  unnest([symbols, capital, mark, repeats]) as share from holdout),
tested as (select stratum, rule, cut, n, strata, count_if(share >= cut and quality = 1)::bigint as k,
                  count_if(share >= cut and quality <> 1) as bad
           from shares join strata using (stratum), (select unnest({list(CUTOFFS)}) as cut)
           group by stratum, rule, cut, n, strata),
passed as (select *, case when k >= n * {ALPHA / len(RULES)!r} then false else
             list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1)
               - lgamma(n - j + 1) + j * ln({ALPHA / len(RULES)!r})
               + (n - j) * ln(1 - {ALPHA / len(RULES)!r}))))
             <= {DELTA / len(RULES)!r} / greatest(1, strata) end as ok from tested),
open as (select *, bool_and(ok) over (partition by stratum, rule order by cut desc) as valid
         from passed),
best as (select stratum, rule, max(cut) as cut from
           (select *, max(bad) over (partition by stratum, rule) as most from open where valid)
         where bad = most and bad > 0 group by stratum, rule),
fired as (select distinct r from (select r, stratum,
            unnest(['symbols', 'capitals', 'marks', 'repeats']) as rule,
            unnest([symbols, capital, mark, repeats]) as share from measured)
          join best using (stratum, rule) where share >= cut)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars,
       n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
       n_repeat_words::bigint as n_repeat_words, base_failed,
       not base_failed and r not in (select r from fired) as kept
from measured
"""
