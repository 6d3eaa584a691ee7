"""Personal data: validated base patterns, and candidates that boosted trees accept.

Base kinds are matched and validated by rule. Beside them high-recall generators propose number-like
and address-like spans, which may overlap base spans and each other. Boosted trees score candidates
by format and context.

Nothing is labelled, so positives are made: validated spans are written, in their own context, in forms
that the base patterns miss (an address with [at] and [dot], a phone number without its plus, a card that
runs into another number), and what the generators propose there is personal. All candidates outside
base spans are unlabelled, never negatives: the trees tell made positives from unlabelled ones, of
equal weight in each kind. The mean score c of a form's positives held out gives the share (1 - c) / c of
unlabelled ones that are like them, and with it a score's chance of being personal; a candidate is
added at CHANCE or more by one of its kind's forms. Every validated span is rewritten, and the trees that
score candidates learn from every row, as counts between the CUTS of each feature. For c, texts fall in
two halves, and all positives of each are scored by trees of the other. Number runs longer than PIECE
characters are candidates in overlapping pieces. All work is done by DataFrame expressions and Spark's
own tree library.

Null text is empty and has no span. Repeated rows are searched each by itself. An empty table gives no
rows. Other columns are not read. A kind with fewer than MIN_CLASS made positives or unlabelled
candidates in either half has none added.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Binarizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.common import masked, span_text, spans, stored

MIN_CLASS = 10
CHANCE = 0.5
TREES, DEPTH = 12, 3
# Characters kept before and after a validated span, for the features of what it is rewritten to.
AROUND = 60
PIECE = 64
MARK = "[personal]"

# The base patterns of the contract, in forms that Java matches without retries. A
# match starts where its run of characters does, or where the match before it ended.
EMAIL = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
)
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
# Generators: at least seven digits with little between them, together, or grouped as phone numbers
# are; names tied to a host in any way.
NUMBER = r"(?<![0-9])\+?\(?[0-9](?:[\x20().\/-]{0,2}[0-9]){6,}+"
HANDLE = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+(?:@|\x20?[\[(]\x20?at\x20?[\])]\x20?)"
    r"[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]\x20?dot\x20?[\])]\x20?)[A-Za-z0-9-]++)*+"
)
DIGITS = r"(?<![0-9])[0-9]{7,19}+(?![0-9])"
GROUPED = (
    r"(?<![0-9])\+?(?:[0-9]{1,3}[\x20-])?(?:\([0-9]{2,4}\)|[0-9]{3})[\x20-]?[0-9]{3}[\x20-][0-9]{4}"
    r"(?![0-9])"
)
LOOSE = {"number": NUMBER, "handle": HANDLE, "digits": DIGITS, "grouped": GROUPED}
HINTS = {
    "hint_call": "(?i)tel|phone|call|mobil|fax|contact|whats",
    "hint_card": "(?i)card|visa|iban|account|konto|tarjeta|carte",
    "hint_id": "(?i)ssn|passport|social|licen|dni|ausweis",
    "hint_mail": "(?i)mail|contact|write|reach",
    "hint_code": "(?i)version|isbn|order|build|token|hash|id\\s*[:=#]",
}


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn check of a string of digits."""
    turned = F.reverse(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)), F.lit(0),
        lambda acc, i: acc + F.transform(
            F.array(F.substr(turned, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)),
            lambda d: d - F.when(d > 9, 9).otherwise(0),
        )[0],
    )
    return total % 10 == 0


def _keep(kind: str):
    def small(part: Column) -> Column:
        bare = F.ltrim(part, F.lit("0"))
        return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))

    def between(m: Column, low: int, high: int) -> Column:
        n = F.length(_digits(m))
        return (n >= low) & (n <= high)

    return {
        "email": lambda m: F.lit(True),
        "ip": lambda m: F.forall(F.split(m, "\\."), small),
        "card": lambda m: between(m, 12, 19) & luhn(_digits(m)),
        "phone": lambda m: between(m, 9, 15),
        **dict.fromkeys(LOOSE, lambda m: F.lit(True)),
    }[kind]


FORMAT = ("chars", "digits", "separators", "groups", "distinct", "longest", "plus", "paren", "at",
          "dots", "luhn_ok", "first")
CONTEXT = (*HINTS, "after_letter", "before_letter", "symbol_near")
# Where trees may split a feature: at these values and above. They are given, and each is a feature of
# two values, since Spark would choose splits of other features by a sample of the rows.
CUTS = {
    "chars": (*range(6, 25), 28, 32, 40, 48, 64), "digits": (*range(1, 21), 24, 28, 32, 48),
    "separators": (*range(1, 9), 12, 16), "groups": (*range(1, 9), 12),
    "distinct": (*range(1, 11),), "longest": (*range(1, 20), 24, 32), "dots": (*range(1, 7),),
    "first": (*range(10),),
    **dict.fromkeys(("plus", "paren", "at", "luhn_ok", *CONTEXT), (1,)),
}


def _features(x: Column, text: Column) -> list[Column]:
    """Format and context of a candidate span ``x`` of the text, as doubles."""
    m = x["found"]
    before = F.substr(text, F.greatest(F.lit(1), x["start"] - 29), F.least(x["start"], F.lit(30)))
    after = F.substr(text, x["end"] + 1, F.lit(2))
    digits = _digits(m)
    runs = F.filter(F.split(m, "[^0-9]+"), lambda r: r != "")
    values = {
        "chars": F.length(m), "digits": F.length(digits),
        "separators": F.length(m) - F.length(F.regexp_replace(m, "[\\x20().\\/-]", "")),
        "groups": F.size(runs),
        "distinct": F.size(F.array_distinct(F.split(digits, ""))),
        "longest": F.coalesce(F.array_max(F.transform(runs, lambda r: F.length(r))), F.lit(0)),
        "plus": F.startswith(m, F.lit("+")), "paren": F.contains(m, F.lit("(")),
        "at": F.contains(m, F.lit("@")),
        "dots": F.length(m) - F.length(F.replace(m, F.lit("."))),
        "luhn_ok": F.when(F.length(digits) >= 12, luhn(digits)).otherwise(F.lit(False)),
        "first": F.coalesce(F.substr(digits, F.lit(1), F.lit(1)).try_cast("int"), F.lit(-1)),
        **{name: before.rlike(pattern) for name, pattern in HINTS.items()},
        "after_letter": after.rlike("^\\p{L}"), "before_letter": before.rlike("\\p{L}$"),
        "symbol_near": before.rlike("[#$%&*=\"']\\s?$") | after.rlike("^[#$%&*=\"']"),
    }
    return [F.coalesce(values[n].cast("double"), F.lit(0.0)).alias(n) for n in (*FORMAT, *CONTEXT)]


def _pieces(x: Column) -> Column:
    """A span as it is, or one longer than PIECE in pieces that overlap by half and end on digits."""
    m = x["found"]

    def piece(at: Column) -> Column:
        cut = F.substr(m, at + 1, F.lit(PIECE))
        bare = F.ltrim(cut, F.lit(" ).-/"))
        start = x["start"] + at + F.length(cut) - F.length(bare)
        found = F.rtrim(bare, F.lit(" ().-/"))
        return F.struct(x["kind"].alias("kind"), x["rank"].alias("rank"), start.alias("start"),
                        (start + F.length(found)).alias("end"), found.alias("found"))

    last = F.length(m) - PIECE // 2 - 1
    return F.when(F.length(m) <= PIECE, F.array(x)).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), last), F.lit(PIECE // 2)), piece)
    )


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``_row``, ``_key``, ``_half`` (the same for equal texts), ``base`` spans, ``shown`` (these with
    the text around them) and ``loose`` candidates with features and ``near_base``."""
    step = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    guard = {
        "email": F.contains("_text", F.lit("@")), "phone": F.contains("_text", F.lit("+")),
        "handle": F.contains("_text", F.lit("@")) | F.col("_text").rlike("[\\[(] ?at ?[\\])]"),
    }
    every = F.col("_text").rlike("[0-9]")
    patterns = {**BASE, **LOOSE}
    step = step.select("*", *[
        F.when(guard.get(kind, every), F.regexp_extract_all("_text", F.lit(p), F.lit(0)))
        .otherwise(F.array().cast("array<string>")).alias(f"_m_{kind}")
        for kind, p in patterns.items()
    ])
    found = {
        kind: spans(F.col("_text"), F.col(f"_m_{kind}"), kind, rank, p, _keep(kind))
        for rank, (kind, p) in enumerate(patterns.items())
    }
    step = step.select(
        "_key", "_text", F.concat(*[found[k] for k in BASE]).alias("base"),
        F.concat(*[F.flatten(F.transform(found[k], _pieces)) if k == "number" else found[k]
                   for k in LOOSE]).alias("_loose"),
    )
    loose = F.transform("_loose", lambda x: F.struct(
        x["kind"].alias("kind"), x["rank"].alias("rank"), x["start"].alias("start"),
        x["end"].alias("end"),
        F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
        .alias("near_base"),
        *_features(x, F.col("_text")),
    ))
    bare = F.transform("base", lambda x: F.struct(
        x["kind"].alias("kind"), x["rank"].alias("rank"), x["start"].alias("start"),
        x["end"].alias("end"),
    ))
    text = F.col("_text")
    shown = F.transform(F.filter("base", lambda x: x["kind"].isin(*FORMS)), lambda x: F.struct(
        x["kind"].alias("kind"), x["found"].alias("found"),
        F.substr(text, F.greatest(F.lit(1), x["start"] - AROUND + 1),
                 F.least(x["start"], F.lit(AROUND))).alias("before"),
        F.substr(text, x["end"] + 1, F.lit(AROUND)).alias("after"),
    ))
    return step.select(
        F.monotonically_increasing_id().alias("_row"), "_key",
        F.pmod(F.xxhash64("_text"), F.lit(2)).cast("int").alias("_half"), bare.alias("base"),
        shown.alias("shown"), loose.alias("loose"),
    )


def _neighbour() -> Column:
    """Eight digits drawn from the span: too many beside a card for both to pass as one."""
    return F.lpad(F.pmod(F.xxhash64("found"), F.lit(10**8)).cast("string"), 8, "0")


# How each base kind is written where its pattern misses it.
FORMS = {
    "email": lambda m: [
        F.replace(m, F.lit("@"), F.lit(" [at] ")), F.replace(m, F.lit("@"), F.lit("(at)")),
        F.concat(F.substring_index(m, "@", 1), F.lit(" [at] "), F.replace(
            F.substring_index(m, "@", -1), F.lit("."), F.lit(" [dot] "))),
    ],
    "phone": lambda m: [F.ltrim(m, F.lit("+")), F.concat(F.lit("0"), F.ltrim(m, F.lit("+")))],
    "card": lambda m: [F.concat_ws(" ", m, _neighbour()), F.concat_ws(" ", _neighbour(), m)],
}


def made_positives(rows: DataFrame) -> DataFrame:
    """Candidates, with features, that rewritten validated spans give; of stored ``candidates`` rows."""
    forms = F.lit(None).cast("array<string>")
    for kind, write in FORMS.items():
        forms = F.when(F.col("kind") == kind, F.array(*write(F.col("found")))).otherwise(forms)
    written = rows.select("_row", "_half", F.inline("shown")).select(
        "_row", "_half", "kind", "before", "after", F.posexplode(forms).alias("nth", "form"))
    low = F.length("before")
    name = F.concat_ws(" ", "kind", "nth").alias("form")
    texts = written.select(
        F.struct("_row", "_half", low.alias("low"), (low + F.length("form")).alias("high"),
                 name).alias("at"),
        F.concat("before", "form", "after").alias("text"))
    found = candidates(texts, "at").select("_key", F.inline("loose"))
    inside = (F.col("start") < F.col("_key.high")) & (F.col("_key.low") < F.col("end"))
    return found.filter(inside & ~F.col("near_base")).select(
        "*", "_key._row", "_key._half", "_key.form").drop("_key")


def shares(counts: dict, rows: int) -> dict:
    """How much of each cell is drawn: equal numbers, and what a small cell leaves to the others.

    For callers who draw rows themselves; ``find`` draws none.
    """
    drawn, left = {}, rows
    for i, (cell, n) in enumerate(sorted(counts.items(), key=lambda x: x[1])):
        take = min(n, left / (len(counts) - i))
        drawn[cell] = take / n
        left -= take
    return drawn


def cells(loose: DataFrame, made: DataFrame) -> DataFrame:
    """``n``, the number of rows of a kind, form, label and half that lie between the same cuts."""
    unlabelled = loose.withColumn("label", F.lit(0.0)).withColumn("form", F.lit(""))

    def cut(name: str) -> Column:
        passed = F.filter(F.array(*[F.lit(float(c)) for c in CUTS[name]]), lambda c: c <= F.col(name))
        return F.coalesce(F.array_max(passed), F.lit(-1.0)).alias(name)

    return unlabelled.unionByName(made.withColumn("label", F.lit(1.0))).groupBy(
        "kind", "form", "label", "_half", *map(cut, CUTS)).agg(F.count("*").alias("n"))


def assembled(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_features``: whether it is of a kind, and whether a feature reaches a cut."""
    kinds = [(f"of_{kind}", kind) for kind in LOOSE]
    rows = rows.withColumns({name: (F.col("kind") == kind).cast("double") for name, kind in kinds})
    steps = [(name, 1) for name, _ in kinds] + [(name, c) for name, at in CUTS.items() for c in at]
    names = [f"{name}_from_{c}" for name, c in steps]
    told = Binarizer(inputCols=[name for name, _ in steps], outputCols=names,
                     thresholds=[c - 0.5 for _, c in steps]).transform(rows)
    return VectorAssembler(inputCols=names, outputCol="_features").transform(told).drop(*names)


def select(loose: DataFrame, made: DataFrame) -> DataFrame:
    """Accepted candidates of rows (_row, _half, kind, rank, start, end, near_base, features).

    ``made`` holds positives of the same columns and their ``form``.
    """
    each = loose.filter(~F.col("near_base"))
    # A document's candidates stay on one side, so no positive is judged by trees that saw its like.
    seen = stored(cells(each, made), "personal-cells")
    sizes = {(r["kind"], r["label"], r["_half"]): r["n"]
             for r in seen.groupBy("kind", "label", "_half").agg(F.sum("n").alias("n")).collect()}
    open_ = [k for k in sorted(LOOSE) if all(
        sizes.get((k, label, half), 0) >= MIN_CLASS for label in (0.0, 1.0) for half in (0, 1))]
    if not open_:
        return each.limit(0)
    seen = seen.filter(F.col("kind").isin(open_))
    trees = GBTClassifier(featuresCol="_features", labelCol="label", maxIter=TREES, maxDepth=DEPTH,
                          seed=17, weightCol="_weight")

    def scored(rows: DataFrame, *halves: int) -> DataFrame:
        """``rows`` with the ``score`` that trees learned from these halves give."""
        weight = F.lit(0.0)
        for kind in open_:
            for label in (0.0, 1.0):
                one = (F.col("kind") == kind) & (F.col("label") == label)
                size = sum(sizes[kind, label, half] for half in halves)
                weight = F.when(one, 1000.0 / size).otherwise(weight)
        learned = seen.filter(F.col("_half").isin(*halves)).withColumn("_weight", weight * F.col("n"))
        return trees.fit(assembled(learned)).transform(assembled(rows)).withColumn(
            "score", vector_to_array("probability")[1]
        )

    positive = seen.filter(F.col("label") == 1)
    held = scored(positive.filter(F.col("_half") == 1), 0).unionByName(
        scored(positive.filter(F.col("_half") == 0), 1))
    forms = held.groupBy("kind", "form").agg(
        (F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("c"), F.sum("n").alias("n"))
    accepted = F.lit(False)
    for r in forms.filter(F.col("n") >= MIN_CLASS).collect():
        # The odds of being personal are (1 - c) / c of the score's; no score under a half is taken.
        odds = CHANCE * r["c"] / max(1 - r["c"], 1e-9)
        accepted |= (F.col("kind") == r["kind"]) & (F.col("score") >= max(0.5, odds / (1 + odds)))
    return scored(each.filter(F.col("kind").isin(open_)), 0, 1).filter(accepted)


def find(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``key`` with ``base`` and ``added`` spans."""
    rows = stored(candidates(docs, key), "personal-candidates")
    loose = rows.filter(F.size("loose") > 0).select("_row", "_half", F.inline("loose"))
    made = stored(made_positives(rows), "personal-made")
    added = select(loose, made).groupBy("_row").agg(
        F.collect_list(F.struct("kind", "rank", "start", "end")).alias("added")
    )
    none = F.array().cast("array<struct<kind:string,rank:int,start:int,end:int>>")
    return rows.select("_row", "_key", "base").join(added, "_row", "left").select(
        F.col("_key").alias(key), "base", F.coalesce("added", none).alias("added")
    )


def redacted(text: Column, base: Column, added: Column, mark: str = MARK) -> Column:
    """The text with every span masked."""
    return masked(text, F.concat(base, added), mark)


def describe(found: DataFrame) -> DataFrame:
    """The contract's digests."""
    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", *[number(kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
