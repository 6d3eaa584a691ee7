"""The enrichment run shared by batch and stream, its result rows and their reports."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.text import clip_text, pad_left, pad_right, shown
from emberwatch.operators import model as learned
from emberwatch.operators.explain import Explainer, explain
from emberwatch.operators.membership import Lookup, flag_in_ranges, flag_listed
from emberwatch.operators.normalize import AsOf, fill_defaults, normalize_alerts
from emberwatch.operators.scoring import with_features, with_rule_severity
from emberwatch.schemas import RESULT_FIELDS, EVENT
from emberwatch.sources.alerts import newest_alerts


def score_alerts(
    alerts: DataFrame, blocklist: Lookup | None = None, model: PipelineModel | None = None,
    as_of: AsOf = None, keep: tuple[str, ...] = (), ranges: bool = False,
) -> DataFrame:
    """Normalise, fill defaults, featurise and score.

    Without a block list and model this is one scan with a projection, no shuffle. ``ranges``
    says that ``blocklist`` holds expanded ranges.
    """
    events = fill_defaults(normalize_alerts(alerts, as_of, keep), keep)
    if blocklist is None:
        flagged = events.withColumn("listed", F.lit(False))
    elif ranges:
        flagged = flag_in_ranges(events, blocklist)
    else:
        flagged = flag_listed(events, blocklist)
    features = with_features(flagged)
    return learned.score(model, features) if model else with_rule_severity(features)


def enrich(
    alerts: DataFrame, blocklist: Lookup | None = None, model: PipelineModel | None = None,
    explainer: Explainer | None = None, as_of: AsOf = None, keep: tuple[str, ...] = (),
    ranges: bool = False,
) -> DataFrame:
    """Alerts to result rows: score, explain, and nest the whole event."""
    scored = score_alerts(alerts, blocklist, model, as_of, keep, ranges)
    return result_rows(explain(scored, explainer), keep)


def result_rows(events: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return events.select(*keep, *RESULT_FIELDS, F.struct(*EVENT.names).alias("event"))


def run_once(
    alerts: DataFrame, batch_size: int = 10, tiebreak: str = "id", by=None, **options
) -> DataFrame:
    """One poll: the newest alerts, enriched."""
    return enrich(newest_alerts(alerts, batch_size, by, tiebreak), **options)


def preview_lines(results: DataFrame) -> DataFrame:
    """One console line per result."""
    return results.select(
        F.concat(
            F.lit("  ["), pad_left(shown(F.col("severity")), 3), F.lit("] "),
            shown(F.col("event_type")), F.lit(" | "), shown(F.col("source_ip")), F.lit(" | "),
            clip_text(F.col("explanation"), 100),
        ).alias("line")
    )


# Report columns and their widths.
REPORT_COLUMNS = [
    ("level", 8), ("source_ip", 18), ("destination_ip", 18), ("port", 8), ("severity", 8),
    ("label", 12), ("status", 0),
]


def report_lines(events: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One padded table line per scored event."""
    cells = [pad_right(shown(F.col(name)), width) for name, width in REPORT_COLUMNS]
    return events.select(*keep, F.concat(F.lit("  "), F.concat_ws(" ", *cells)).alias("line"))


def report_table(events: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The report with its header: line 0 names the columns, line 1 rules them off, all others are 2."""
    head = "  " + " ".join(name.ljust(width) for name, width in REPORT_COLUMNS)
    rule = "  " + " ".join("-" * (width or len(name)) for name, width in REPORT_COLUMNS)
    nothing = [F.lit(None).cast(events.schema[name].dataType).alias(name) for name in keep]
    top = events.sparkSession.range(0, 2, 1, 1).select(
        *nothing, F.col("id").cast("int").alias("place"),
        F.when(F.col("id") == 0, head).otherwise(rule).alias("line"))
    return top.unionByName(report_lines(events, keep).withColumn("place", F.lit(2)))
