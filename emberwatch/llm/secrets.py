"""Secret scans: candidates by pattern, told apart by who else holds the same value.

Base patterns and a few token shapes propose spans. A hash of each candidate's value is counted over
the whole corpus by distinct owners and repositories. A value that WIDE owners or more hold is a
copied example; one that fewer hold and that does not look like a placeholder is taken as live.
Base spans are always reported; shaped ones only when live. Everything is a DataFrame expression.

Null text is empty and has no span. A null source counts as one owner with an empty name. The same
document given twice counts once for its owner. Texts without any candidate skip the patterns. An
empty table gives no rows. Columns other than those named are not read, and kept by ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.common import masked, span_text, spans, stored

WIDE = 3
MARK = "[secret]"

# The base patterns of the contract, in forms that Java matches without retries.
ASSIGN = (
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}+"
BASE = ("assign", "access", "hex")
# Shapes of issued tokens, session tokens and key files.
KEY = (
    r"(?<![A-Za-z0-9])(?:gh[opsur]_|github_pat_|glpat-|sk_live_|rk_live_|sk-|npm_|xox[abprs]-)"
    r"[A-Za-z0-9_-]{16,}+"
)
JWT = r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"
PEM = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "key": KEY, "jwt": JWT, "pem": PEM}
ANY = (
    r"(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{16}|eyJ|PRIVATE KEY"
    r"|(?:gh[opsur]|pat|live|npm)_|glpat-|sk-|xox"
)
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|your[-_]|xxxx|(.)\1{7,}"


def _keep(kind: str):
    if kind == "assign":
        return lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 12
    return lambda m: F.lit(True)


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_spans``: every candidate of the whole text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    step = docs.withColumn("_whole", whole).withColumn("_any", F.col("_whole").rlike(ANY))
    empty = F.array().cast("array<string>")
    step = step.withColumns({
        f"_m_{kind}": F.when(F.col("_any"), F.regexp_extract_all("_whole", F.lit(pattern), F.lit(0)))
        .otherwise(empty) for kind, pattern in PATTERNS.items()
    })
    found = [
        spans(F.col("_whole"), F.col(f"_m_{kind}"), kind, rank, pattern, _keep(kind))
        for rank, (kind, pattern) in enumerate(PATTERNS.items())
    ]
    step = step.withColumn("_spans", F.concat(*found))
    return step.drop("_whole", "_any", *[f"_m_{kind}" for kind in PATTERNS])


def _value(span: Column) -> Column:
    return F.when(
        span["kind"] == "assign", F.regexp_extract(span["found"], ASSIGN, 1)
    ).otherwise(span["found"])


def _hashed(found: Column) -> Column:
    """Spans with a digest of the value in place of the text."""
    return F.transform(found, lambda x: F.struct(
        x["kind"].alias("kind"), x["rank"].alias("rank"), x["start"].alias("start"),
        x["end"].alias("end"), F.sha2(_value(x), 256).alias("hash"),
        _value(x).rlike(PLACEHOLDER).alias("placeholder"),
    ))


def ownership(held: DataFrame) -> DataFrame:
    """Distinct owners and repositories of every ``hash`` of (hash, owner, repository) rows.

    Rows are made distinct before they meet by hash, so a value that a third of all documents
    hold arrives as one row per repository and input slice.
    """
    pairs = held.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("_one"))
    return pairs.groupBy("hash", "owner").agg(F.count("*").alias("n")).groupBy("hash").agg(
        F.count("*").alias("owners"), F.sum("n").alias("repositories")
    )


def scan(docs: DataFrame, key: str = "doc_id", source: str = "source") -> DataFrame:
    """Rows of ``key`` with base spans, all candidates' verdicts, and their ownership.

    ``owner`` is the part of the source before the first slash, ``repository`` the whole source.
    """
    repository = F.coalesce(F.col(source), F.lit(""))
    rows = candidates(docs.select(F.col(key).alias("_key"), "text", repository.alias("repository")))
    rows = stored(rows.select(
        F.monotonically_increasing_id().alias("_row"), "_key", "repository",
        _hashed(F.col("_spans")).alias("_spans"),
    ), "secret-candidates")
    each = rows.filter(F.size("_spans") > 0).select(
        "_row", "repository", F.substring_index("repository", "/", 1).alias("owner"),
        F.explode("_spans").alias("span"),
    )
    counted = ownership(each.select("span.hash", "owner", "repository"))
    live = (F.col("owners") < WIDE) & ~F.col("span.placeholder")
    judged = each.withColumn("hash", F.col("span.hash")).join(counted, "hash").groupBy("_row").agg(
        F.collect_list(F.struct(
            "span.kind", "span.rank", "span.start", "span.end", live.alias("live"), "owners",
            "repositories",
        )).alias("found")
    )
    none = "array<struct<kind:string,rank:int,start:int,end:int,live:boolean,owners:bigint," \
           "repositories:bigint>>"
    return rows.select("_row", "_key").join(judged, "_row", "left").select(
        F.col("_key").alias(key), F.coalesce("found", F.array().cast(none)).alias("found")
    )


def reported(found: Column) -> Column:
    return F.filter(found, lambda x: x["kind"].isin(*BASE) | x["live"])


def redact(docs: DataFrame, mark: str = MARK) -> DataFrame:
    """The documents with live secrets masked; ``n_chars`` follows where there is one.

    Only texts that hold a candidate meet the verdicts; the others pass without a shuffle.
    """
    suspect = F.coalesce(F.col("text").rlike(ANY), F.lit(False))
    source = F.coalesce(F.col("source"), F.lit(""))
    # Rows are carried whole, so no column of theirs can clash with those made here.
    some = docs.filter(suspect).select(
        F.struct("*").alias("row"), "text", "source",
        F.sha2(F.concat_ws("\x00", "text", source), 256).alias("match"),
    )
    verdicts = scan(some, "match").select(
        "match", F.filter("found", lambda x: x["live"]).alias("live")
    ).filter(F.size("live") > 0)
    # Copies of one text from one source have the same verdict.
    verdicts = stored(
        verdicts.groupBy("match").agg(F.any_value("live").alias("live")), "secret-verdicts"
    )
    text = masked(F.col("text"), F.col("live"), mark)
    row = F.col("row").withField("text", text)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        row = row.withField("n_chars", F.length(text).cast(kind))
    fixed = some.join(verdicts, "match", "left").select(
        F.when(F.col("live").isNull(), F.col("row")).otherwise(row).alias("row")
    )
    return docs.filter(~suspect).unionByName(fixed.select("row.*"))


def describe(found: DataFrame) -> DataFrame:
    """The contract's digests of scanned documents."""
    base = F.filter("found", lambda x: x["kind"].isin(*BASE))

    def number(kind: str) -> Column:
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", *[number(kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(reported(F.col("found"))).alias("spans"),
        F.size(F.filter("found", lambda x: x["live"])).cast("long").alias("n_live"),
        F.size(F.filter("found", lambda x: x["owners"] >= WIDE)).cast("long").alias("n_copied"),
    )
