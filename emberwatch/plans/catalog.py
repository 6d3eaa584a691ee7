"""The registered queries. Each takes a session and the folder of the given tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.functions import ipaddr
from emberwatch.functions.extract import addresses, clock, nth_address, parse_timestamp, parse_user
from emberwatch.functions.scoring import label_of, rule_score
from emberwatch.operators import (
    boosting, buffer, dashboard, explain, membership, model, networks, replay, results, sinks,
)
from emberwatch.operators.normalize import (
    fill_defaults, normalize_alerts, normalize_fields, normalize_logs, row_json,
)
from emberwatch.operators.scoring import FEATURES
from emberwatch.plans import tables
from emberwatch.schemas import ALERT, EVENT
from emberwatch.session import apply_settings, scratch_path
from emberwatch.sources import alerts as alert_source
from emberwatch.sources import polling, recent
from emberwatch.sources.blocklist import clean_blocklist
from emberwatch.sources.logs import read_log_csv
from emberwatch.sources.synthetic import synthesize
from emberwatch.streaming import alerts as streams
from emberwatch.streaming import panes

# Rows without a usable time fall back to this moment, and year-less times to its year.
AS_OF = "2024-02-15T12:00:00+00:00"
KPI_TIME = "2024-01-20 00:00:00"
READING_TIMES = [
    "2024-01-02 06:01:00", "2024-01-20 00:00:00", "2024-01-20 13:37:00", "2024-01-31 23:59:00",
    "2030-01-01 00:00:00",
]
REPLAY_CATEGORY = "error"
REPLAY_LIMIT = 100
KEEP = ("alert_id",)

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        apply_settings(spark)
        return fn(spark, sf_dir)

    REGISTRY[fn.__name__] = run
    return run


def _blocklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_blocklist(tables.blocklist_lines(spark, sf_dir))


def _scored(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = KEEP) -> DataFrame:
    lookup = membership.checked(_blocklist(spark, sf_dir))
    return results.score_alerts(tables.alerts(spark, sf_dir), lookup, as_of=AS_OF, keep=keep)


# Normalisation


@query
def normalize_siem_alerts(spark, sf_dir):
    events = normalize_alerts(tables.alerts(spark, sf_dir), AS_OF, KEEP)
    return events.drop("target_port", "origin_port")


@query
def normalize_csv_rows(spark, sf_dir):
    rows = tables.raw_logs(spark, sf_dir)
    events = normalize_logs(rows, as_of=AS_OF, row_columns=["log", "category"], keep=("seq",))
    return events.select(
        "*", F.element_at("raw", "log").alias("kept_log"),
        F.element_at("raw", "category").alias("kept_category"),
    ).drop("raw")


@query
def normalize_csv_fields(spark, sf_dir):
    rows = tables.field_rows(spark, sf_dir)
    events = normalize_fields(rows, as_of=AS_OF, keep=("seq",))
    return events.select(
        "*", F.element_at("context", "dst_ip").alias("kept_dst_ip"),
        F.size("context").alias("kept_columns"),
    ).drop("context")


@query
def normalize_conversations(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "conversations").selectExpr(
        "conv_id", "turn", "text as log", "role as category"
    )
    return normalize_logs(
        rows, "conversations", AS_OF, ["log", "category"], ("conv_id", "turn")
    ).drop("raw")


@query
def parse_timestamps(spark, sf_dir):
    return tables.raw_logs(spark, sf_dir).select(
        "seq",
        parse_timestamp(F.coalesce("log", F.lit("")), clock(AS_OF)).alias("timestamp"),
    )


@query
def parse_users(spark, sf_dir):
    return tables.raw_logs(spark, sf_dir).select("seq", parse_user(F.col("log")).alias("user"))


def _first_addresses(rows: DataFrame, key: str, text: str) -> DataFrame:
    found = rows.select(key, addresses(F.col(text)).alias("found"))
    return found.select(
        key, nth_address(F.col("found"), 0).alias("source_ip"),
        nth_address(F.col("found"), 1).alias("destination_ip"),
    )


@query
def extract_ips_documents(spark, sf_dir):
    return _first_addresses(tables.table(spark, sf_dir, "documents"), "doc_id", "text")


@query
def extract_ips_pages(spark, sf_dir):
    return _first_addresses(tables.table(spark, sf_dir, "pages"), "page_id", "html")


@query
def extract_users_documents(spark, sf_dir):
    return tables.table(spark, sf_dir, "documents").select(
        "doc_id",
        parse_user(F.col("text")).alias("user"),
        parse_timestamp(F.col("text"), clock(AS_OF)).alias("timestamp"),
    )


@query
def event_json(spark, sf_dir):
    """Whole events as JSON text, read back field by field."""
    events = normalize_alerts(tables.alerts(spark, sf_dir), AS_OF, KEEP)
    events = events.drop("target_port", "origin_port")
    packed = events.select("alert_id", row_json(events).alias("packed"))
    return packed.select(
        "alert_id",
        *[F.get_json_object("packed", f"$.{name}").alias(name)
          for name in ("source_ip", "user", "port", "status")],
    )


# Addresses, features and scores


@query
def ip_classes(spark, sf_dir):
    events = fill_defaults(normalize_alerts(tables.alerts(spark, sf_dir), AS_OF, KEEP), KEEP)
    source, destination = F.col("source_ip"), F.col("destination_ip")
    return events.select(
        "alert_id", "source_ip", "destination_ip",
        ipaddr.is_private(source).alias("source_private"),
        ipaddr.is_private(destination).alias("destination_private"),
        ipaddr.is_internal_server(destination).alias("destination_internal"),
    )


@query
def ip_classes_wide(spark, sf_dir):
    """Addresses spread over the whole space, invalid spellings included."""
    rows = tables.spread_addresses(spark, sf_dir)
    return rows.select(
        "event_id", "ip", ipaddr.is_private(F.col("ip")).alias("private"),
        ipaddr.is_internal_server(F.col("ip")).alias("internal"),
    )


@query
def ip_classes_v6(spark, sf_dir):
    rows = tables.colon_addresses(spark, sf_dir)
    return rows.select("event_id", "ip", ipaddr.is_private(F.col("ip")).alias("private"))


@query
def adapter_defaults(spark, sf_dir):
    return fill_defaults(normalize_alerts(tables.alerts(spark, sf_dir), AS_OF, KEEP), KEEP)


@query
def features(spark, sf_dir):
    return _scored(spark, sf_dir).select("alert_id", "listed", *FEATURES)


@query
def rule_severity(spark, sf_dir):
    return _scored(spark, sf_dir).select("alert_id", "severity", "label", "status")


@query
def label_counts(spark, sf_dir):
    return _scored(spark, sf_dir).groupBy("label").agg(F.count("*").alias("events"))


# Block list


@query
def blocklist_clean(spark, sf_dir):
    return _blocklist(spark, sf_dir)


@query
def blocklist_size(spark, sf_dir):
    return _blocklist(spark, sf_dir).agg(F.count("*").alias("entries"))


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = normalize_alerts(tables.alerts(spark, sf_dir), AS_OF, KEEP)
    return events.select("alert_id", "source_ip")


@query
def blocklist_flag(spark, sf_dir):
    lookup = membership.checked(_blocklist(spark, sf_dir))
    return membership.flag_listed(_sources(spark, sf_dir), lookup)


@query
def blocklist_flag_shuffled(spark, sf_dir):
    """The same flag by the way taken when the list is too large to broadcast."""
    lookup = membership.Lookup(_blocklist(spark, sf_dir), small=False)
    return membership.flag_listed(_sources(spark, sf_dir), lookup)


@query
def blocklist_flag_hot(spark, sf_dir):
    """The same flag where even the listed addresses of the events are too many to broadcast."""
    lookup = membership.checked(_blocklist(spark, sf_dir), max_rows=0)
    return membership.flag_listed(_sources(spark, sf_dir), lookup)


@query
def blocklist_semi(spark, sf_dir):
    lookup = membership.checked(_blocklist(spark, sf_dir))
    return membership.only_listed(_sources(spark, sf_dir), lookup)


@query
def blocklist_anti(spark, sf_dir):
    lookup = membership.checked(_blocklist(spark, sf_dir))
    return membership.only_unlisted(_sources(spark, sf_dir), lookup)


@query
def blocklist_semi_shuffled(spark, sf_dir):
    lookup = membership.Lookup(_blocklist(spark, sf_dir), small=False)
    return membership.only_listed(_sources(spark, sf_dir), lookup)


@query
def blocklist_anti_shuffled(spark, sf_dir):
    lookup = membership.Lookup(_blocklist(spark, sf_dir), small=False)
    return membership.only_unlisted(_sources(spark, sf_dir), lookup)


@query
def blocklist_cidr(spark, sf_dir):
    ranges = membership.checked(membership.expand_ranges(_blocklist(spark, sf_dir)))
    return membership.flag_in_ranges(_sources(spark, sf_dir), ranges)


@query
def blocklist_cidr_shuffled(spark, sf_dir):
    """The same flag by the way taken when the list is too large to broadcast."""
    ranges = membership.Lookup(membership.expand_ranges(_blocklist(spark, sf_dir)), small=False)
    return membership.flag_in_ranges(_sources(spark, sf_dir), ranges)


@query
def blocklist_networks(spark, sf_dir):
    """Addresses of both families in a list of overlapping networks."""
    listed = networks.checked_networks(tables.networks(spark, sf_dir))
    return networks.flag_in_networks(tables.mixed_addresses(spark, sf_dir), listed, "ip")


@query
def blocklist_networks_swept(spark, sf_dir):
    """The same flag by the way taken when the intervals are too many to broadcast."""
    listed = networks.checked_networks(tables.networks(spark, sf_dir), max_rows=0)
    return networks.flag_in_networks(tables.mixed_addresses(spark, sf_dir), listed, "ip")


@query
def blocklist_intervals(spark, sf_dir):
    """The networks of the list as disjoint intervals."""
    return networks.disjoint(networks.intervals(tables.networks(spark, sf_dir)))


# Newest alerts, buffer and dashboard


@query
def recent_alerts_topn(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "events")
    newest = alert_source.newest_alerts(rows, 10, F.col("ts"), "event_id")
    return tables.flat_alerts(newest)


@query
def recent_alerts_pruned(spark, sf_dir):
    """The same newest ten out of a folder of files by day, with an index of their time ranges."""
    path, index = scratch_path(spark, "alert-days"), scratch_path(spark, "alert-index")
    rows = tables.table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    rows.withColumn("day", F.to_date("ts")).repartition("day").write.partitionBy("day").parquet(path)
    newest = recent.newest_from_files(spark, path, index, 10, "at", "event_id")
    return tables.flat_alerts(newest.drop("at", "day"))


_POLL = "cast(date_format(ts, 'yyyyMMddHH') as bigint)"
_BUFFER_ORDER = [("batch_id", True), ("ts", False), ("alert_id", False)]


@query
def recent_events_buffer(spark, sf_dir):
    """Results of hourly polls in insertion order, of which the buffer keeps the end."""
    polled = tables.alerts(spark, sf_dir).withColumn("batch_id", F.expr(_POLL))
    half = F.col("alert_id") % 2 == 0
    events = buffer.append_events(polled.filter(half), polled.filter(~half))
    page = buffer.recent_events(events, _BUFFER_ORDER, 100)
    keep = ("alert_id", "batch_id")
    return results.score_alerts(page, as_of=AS_OF, keep=keep).select(
        *keep, "event_type", "source_ip", "severity", "label"
    )


@query
def recent_events_tail(spark, sf_dir):
    """A negative page leaves out the start of the buffer."""
    polled = tables.alerts(spark, sf_dir).withColumn("batch_id", F.expr(_POLL))
    page = buffer.recent_events(polled, _BUFFER_ORDER, -120)
    return page.select("alert_id", "batch_id")


def _dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.dashboard_alerts(_scored(spark, sf_dir, ("alert_id", "ts")))


@query
def severity_kpis(spark, sf_dir):
    return dashboard.severity_kpis(_dashboard(spark, sf_dir))


@query
def severity_kpis_24h(spark, sf_dir):
    at = F.lit(KPI_TIME).cast("timestamp_ntz")
    return dashboard.kpis_since(_dashboard(spark, sf_dir), at)


@query
def display_bands(spark, sf_dir):
    return dashboard.dashboard_table(_dashboard(spark, sf_dir))


# Results and reports


def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    lookup = membership.checked(_blocklist(spark, sf_dir))
    return results.enrich(tables.alerts(spark, sf_dir), lookup, as_of=AS_OF, keep=KEEP)


def _unpacked(rows: DataFrame) -> DataFrame:
    """Result rows with the nested event spread out, for a flat comparison."""
    outer = ["alert_id", "timestamp", "event_type", "source_ip", "severity", "label", "explanation"]
    return rows.select(*outer, *[F.col(f"event.{n}").alias(f"event_{n}") for n in EVENT.names])


@query
def alert_results(spark, sf_dir):
    return _unpacked(_enriched(spark, sf_dir))


@query
def alert_results_poll(spark, sf_dir):
    """One poll: the newest ten alerts enriched."""
    rows = results.run_once(
        tables.alerts(spark, sf_dir), 10, "alert_id", F.col("ts"), as_of=AS_OF, keep=KEEP
    )
    return _unpacked(rows)


@query
def report_preview(spark, sf_dir):
    rows = results.run_once(
        tables.alerts(spark, sf_dir), 3, "alert_id", F.col("ts"), as_of=AS_OF
    )
    return results.preview_lines(rows)


@query
def score_report(spark, sf_dir):
    return results.report_lines(_scored(spark, sf_dir), KEEP)


@query
def score_report_table(spark, sf_dir):
    """The report with header, rule and rows."""
    return results.report_table(_scored(spark, sf_dir), KEEP)


# Replay


@query
def replay_selection(spark, sf_dir):
    rows = tables.raw_logs(spark, sf_dir)
    return replay.replay_lines(replay.select_replay(rows, REPLAY_CATEGORY, REPLAY_LIMIT), ("seq",))


@query
def replay_selection_cut(spark, sf_dir):
    """The same selection by the way taken when the limit is too large for a top-k."""
    rows = tables.raw_logs(spark, sf_dir)
    chosen = replay.select_replay(rows, REPLAY_CATEGORY, REPLAY_LIMIT, top=0)
    return replay.replay_lines(chosen, ("seq",))


@query
def replay_everything(spark, sf_dir):
    rows = tables.raw_logs(spark, sf_dir)
    return replay.replay_lines(replay.select_replay(rows, None, 0), ("seq",))


@query
def replay_counters(spark, sf_dir):
    return replay.count_replay(tables.raw_logs(spark, sf_dir), REPLAY_CATEGORY, REPLAY_LIMIT)


@query
def replay_sink(spark, sf_dir):
    """Replayed lines written as text and read back."""
    path = scratch_path(spark, "replay")
    replay.write_lines(replay.replay_lines(tables.raw_logs(spark, sf_dir)), path)
    return spark.read.text(path)


# Scans and sinks through files


@query
def csv_logs_to_json(spark, sf_dir):
    """Raw logs through CSV, normalisation and the JSON sink, read back."""
    source, target = scratch_path(spark, "logs-csv"), scratch_path(spark, "logs-json")
    rows = tables.raw_logs(spark, sf_dir).selectExpr("cast(seq as string) as seq", "log", "category")
    rows.write.option("header", True).option("escape", '"').csv(source)
    read = read_log_csv(spark, source, multi_line=True)
    sinks.write_json(
        normalize_logs(read, as_of=AS_OF, row_columns=["log", "category"], keep=("seq",)), target
    )
    columns = "seq string, timestamp string, event_type string, source_ip string, " \
              "destination_ip string, user string, severity int, message string, source string"
    back = spark.read.schema(columns).json(target)
    return back.withColumn("seq", F.col("seq").cast("bigint"))


@query
def csv_fields_to_json(spark, sf_dir):
    """Rows with field columns through CSV with a header of its own, and the JSON sink."""
    source, target = scratch_path(spark, "fields-csv"), scratch_path(spark, "fields-json")
    rows = tables.field_rows(spark, sf_dir)
    text = [F.col(c).cast("string").alias(c) for c in reversed(rows.columns)]
    rows.select(*text).write.option("header", True).option("escape", '"').csv(source)
    events = normalize_fields(read_log_csv(spark, source), as_of=AS_OF, keep=("seq",))
    sinks.write_json(events.drop("context"), target)
    kept = ["timestamp", "source_ip", "destination_ip", "event_type", "user", "message"]
    back = spark.read.schema(", ".join(f"{c} string" for c in ["seq", *kept])).json(target)
    return back.withColumn("seq", F.col("seq").cast("bigint"))


@query
def logs_to_json_array(spark, sf_dir):
    """Normalised logs as one JSON array over part files, read back as one document each line."""
    target = scratch_path(spark, "logs-array")
    events = normalize_logs(tables.raw_logs(spark, sf_dir), as_of=AS_OF,
                            row_columns=["log", "category"], keep=("seq",))
    sinks.write_json_array(events.select("seq", "timestamp", "event_type", "source_ip", "user"), target)
    # Every element stands in a line of its own, behind a comma unless it is the first.
    lines = spark.read.text(target).filter(~F.col("value").isin("[", "]"))
    element = F.from_json(F.regexp_replace("value", "^,", ""), "seq bigint, timestamp string, "
                          "event_type string, source_ip string, user string", {"mode": "FAILFAST"})
    return lines.select(element.alias("x")).select("x.*")


@query
def json_alert_scan(spark, sf_dir):
    """Alerts written as JSON lines, scanned with the alert schema and normalised."""
    path = scratch_path(spark, "alerts-json")
    tables.alerts(spark, sf_dir).drop("alert_id", "ts").write.json(path)
    events = normalize_alerts(alert_source.read_alerts(spark, path), AS_OF, ("id",))
    return events.drop("target_port", "origin_port")


@query
def envelope_scan(spark, sf_dir):
    """Alerts out of search answers held as text; some answers have no hits."""
    nested = tables.alerts(spark, sf_dir)
    hit = F.struct(F.struct(*[F.col(n) for n in nested.columns if n in ALERT.names])
                   .alias("_source"))
    hits = F.when(F.col("alert_id") % 10 == 0, F.slice(F.array(hit), 1, 0)).otherwise(F.array(hit))
    answers = nested.select(F.to_json(F.struct(F.struct(hits.alias("hits")).alias("hits")))
                            .alias("value"))
    events = normalize_alerts(alert_source.parse_envelopes(answers), AS_OF, ("id",))
    return events.select("id", "source_ip", "destination_ip", "user", "event_type", "level")


# Model


@query
def synthetic_events(spark, sf_dir):
    return synthesize(tables.table(spark, sf_dir, "events"), "event_id")


# Models trained in this application, by table folder: a saved model and its stored cells.
_MODELS: dict[tuple[str, str], tuple[str, str]] = {}
# Stated bounds: mean error on held-out rows, whose noise alone gives 2.5; and distance to the rule.
# Random training rows hardly ever have a common port (5) or an internal target (16), so the
# model knows neither, and its own error comes on top.
MAE_BOUND = 4.0
RULE_BOUND = 30
# Distance to the rule for the leaf-wise model, where training rows are many.
LEAF_BOUND = 8


def _trained(spark: SparkSession, sf_dir: str):
    """The model of these tables, trained once and then loaded from where it was saved."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MODELS:
        rows = synthesize(tables.table(spark, sf_dir, "events"), "event_id")
        folded = model.fold(model.training_features(rows))
        paths = scratch_path(spark, "model"), scratch_path(spark, "model-cells")
        model.save(model.fit(folded), paths[0])
        folded.write.parquet(paths[1])
        _MODELS[key] = paths
    path, cells = _MODELS[key]
    return model.load(path), spark.read.parquet(cells)


@query
def model_cells(spark, sf_dir):
    rows = synthesize(tables.table(spark, sf_dir, "events"), "event_id")
    return model.fold(model.training_features(rows))


@query
def model_mae(spark, sf_dir):
    error = model.mean_absolute_error(*_trained(spark, sf_dir))
    return error.select("test_rows", (F.col("mae") <= MAE_BOUND).alias("within_bound"))


@query
def model_scores(spark, sf_dir):
    fitted, _ = _trained(spark, sf_dir)
    lookup = membership.checked(_blocklist(spark, sf_dir))
    scored = results.score_alerts(
        tables.alerts(spark, sf_dir), lookup, fitted, as_of=AS_OF, keep=KEEP
    )
    # The model is trained without listed addresses, so the rule it learns has none either.
    source = F.col("source_ip_security") % 10
    rule = rule_score(F.col("level"), source, F.col("destination_ip_security"),
                      F.col("port_security"))
    return scored.select(
        "alert_id", *FEATURES,
        (F.abs(F.col("severity") - rule) <= RULE_BOUND).alias("within_bound"),
        (F.col("label") == label_of(F.col("severity"))).alias("label_fits"),
    )


@query
def model_reuse(spark, sf_dir):
    """A saved model, loaded twice and saved again between, scores alike."""
    one, _ = _trained(spark, sf_dir)
    path = scratch_path(spark, "model-copy")
    model.save(one, path)
    alerts = tables.alerts(spark, sf_dir)
    first, second = [
        results.score_alerts(alerts, None, fitted, as_of=AS_OF, keep=KEEP)
        .select("alert_id", F.col("severity").alias(name))
        for fitted, name in ((one, "first"), (model.load(path), "second"))
    ]
    same = F.col("first").eqNullSafe(F.col("second"))
    return first.join(second, "alert_id").select("alert_id", same.alias("same"))


def _leafwise(spark: SparkSession, sf_dir: str) -> tuple[boosting.LeafwiseModel, DataFrame]:
    rows = synthesize(tables.table(spark, sf_dir, "events"), "event_id")
    folded = model.fold(model.training_features(rows))
    return boosting.fit_leafwise(folded), folded


@query
def leafwise_root(spark, sf_dir):
    """The first split of the first tree: the gain of the best cut over all training rows."""
    fitted, _ = _leafwise(spark, sf_dir)
    path = scratch_path(spark, "leafwise")
    fitted.save(spark, path)
    root = spark.read.parquet(f"{path}/splits").filter("tree = 0 and node = 0")
    return root.select("feature", "threshold", F.round("gain", 3).alias("gain"),
                       F.col("weight").cast("bigint").alias("train_rows"))


@query
def leafwise_mae(spark, sf_dir):
    error = model.mean_absolute_error(*_leafwise(spark, sf_dir))
    return error.select("test_rows", (F.col("mae") <= MAE_BOUND).alias("within_bound"))


@query
def leafwise_stream(spark, sf_dir):
    """A saved leaf-wise model inside a stream gives every alert the score it has in a batch.

    Where training rows are many (no common port, no internal target) a score is close to the rule.
    """
    fitted, _ = _leafwise(spark, sf_dir)
    model_path, path = scratch_path(spark, "leafwise"), scratch_path(spark, "stream-results")
    fitted.save(spark, model_path)
    loaded = boosting.LeafwiseModel.load(spark, model_path)
    run = streams.start_results(
        _alert_stream(spark, sf_dir, 3),
        lambda batch: results.score_alerts(batch, None, loaded, as_of=AS_OF, keep=KEEP), path,
        scratch_path(spark, "stream-state"), once=True,
    )
    run.awaitTermination()
    streamed = spark.read.parquet(path).select("alert_id", F.col("severity").alias("streamed"))
    scored = results.score_alerts(tables.alerts(spark, sf_dir), None, fitted, as_of=AS_OF, keep=KEEP)
    rule = rule_score(*[F.col(f) for f in FEATURES])
    common = (F.col("port_security") == 0) & (F.col("destination_ip_security") <= 3)
    return scored.join(streamed, "alert_id").select(
        "alert_id", F.col("streamed").eqNullSafe(F.col("severity")).alias("same"),
        (~common | (F.abs(F.col("severity") - rule) <= LEAF_BOUND)).alias("within_bound"),
    )


@query
def explanation_prompts(spark, sf_dir):
    scored = results.score_alerts(tables.alerts(spark, sf_dir), as_of=AS_OF, keep=KEEP)
    asked = explain.explanation_input(scored, KEEP)
    return asked.select("alert_id", explain.prompt().alias("prompt"))


@query
def explained_by_callable(spark, sf_dir):
    """Explanations by a callable in place of a text model: the prompt's length."""
    scored = results.score_alerts(tables.alerts(spark, sf_dir), as_of=AS_OF, keep=KEEP)
    told = explain.explain(scored, _told)
    return told.select("alert_id", "explanation", "status")


@query
def explained_once(spark, sf_dir):
    """Two batches of the same events; the second one's prompts have answers already."""
    path = scratch_path(spark, "answers")
    scored = results.score_alerts(tables.alerts(spark, sf_dir), as_of=AS_OF, keep=KEEP)
    explain.explain_once(scored.filter("alert_id % 2 = 0"), _told, path)
    return explain.explain_once(scored, _told, path).select("alert_id", "explanation", "status")


def _told(prompts):
    return "a prompt of " + prompts.str.len().astype(str)


# Streams, each run to the end of the available files


def _alert_stream(
    spark: SparkSession, sf_dir: str, files: int, copies: int = 1
) -> DataFrame:
    """Alerts written to several files in no order of time, and streamed one file per batch."""
    path = scratch_path(spark, "alert-files")
    rows = tables.alerts(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    place = F.pmod(F.xxhash64("alert_id", "_copy"), F.lit(files)).cast("int")
    rows.withColumn("_place", place).repartitionById(files, F.col("_place")).drop(
        "_copy", "_place"
    ).write.parquet(path)
    return alert_source.stream_alerts(spark, path, 1, rows.drop("_copy").schema, "parquet")


@query
def stream_results_once(spark, sf_dir):
    lookup = membership.checked(_blocklist(spark, sf_dir))
    path = scratch_path(spark, "stream-results")
    run = streams.start_results(
        _alert_stream(spark, sf_dir, 4),
        lambda batch: results.enrich(batch, lookup, as_of=AS_OF, keep=KEEP),
        path, scratch_path(spark, "stream-state"), once=True, key="alert_id",
    )
    run.awaitTermination()
    return _unpacked(spark.read.parquet(path))


@query
def stream_repeats(spark, sf_dir):
    """Every alert three times over six unordered batches; each comes out once."""
    path = scratch_path(spark, "stream-results")
    stream = _alert_stream(spark, sf_dir, 6, copies=3)
    # Without ids, as a search answer gives them, so the whole alert is the key.
    bare = [name for name in stream.columns if name != "id"]
    stream = stream.withColumn("id", F.lit(None).cast("string"))
    stream = stream.withColumn("_key", streams.alert_key(bare + ["id"]))
    run = streams.start_results(
        stream, lambda batch: results.score_alerts(batch, as_of=AS_OF, keep=KEEP),
        path, scratch_path(spark, "stream-state"), once=True, key="_key",
    )
    run.awaitTermination()
    return spark.read.parquet(path).select("alert_id", "severity", "label", "status")


@query
def stream_kpi_24h(spark, sf_dir):
    path = scratch_path(spark, "stream-kpis")
    scored = results.score_alerts(
        _alert_stream(spark, sf_dir, 4, copies=2), as_of=AS_OF, keep=("alert_id", "ts")
    )
    run = streams.start_daily_counts(
        tables.dashboard_alerts(scored).withColumn("alert_id", F.col("id")), path,
        scratch_path(spark, "stream-state"), once=True, key="alert_id",
    )
    run.awaitTermination()
    counts = streams.latest_counts(spark, path)
    return counts.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss")).withColumn(
        "end", F.date_format("end", "yyyy-MM-dd HH:mm:ss")
    )


@query
def stream_kpi_rolling(spark, sf_dir):
    """The 24 hours up to several reading times; alerts arrive in no order of time, and repeated."""
    path = scratch_path(spark, "stream-panes")
    scored = results.score_alerts(
        _alert_stream(spark, sf_dir, 4, copies=2), as_of=AS_OF, keep=("alert_id", "ts")
    )
    run = panes.start_rolling_counts(
        tables.dashboard_alerts(scored), path, scratch_path(spark, "stream-state"), once=True, key="id",
    )
    run.awaitTermination()
    counts = panes.rolling_counts(spark, path, [datetime.fromisoformat(t) for t in READING_TIMES])
    return counts.withColumn("as_of", F.date_format("as_of", "yyyy-MM-dd HH:mm:ss"))


@query
def stream_buffer(spark, sf_dir):
    """The last 500 results of three streams, each with a checkpoint of its own, on one buffer.

    Every stream finds the alerts of those before it again and adds the third that is new.
    """
    source, path = scratch_path(spark, "alert-files"), scratch_path(spark, "stream-results")
    kept = scratch_path(spark, "stream-buffer")
    rows = tables.alerts(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    order = [("ts", False), ("alert_id", False)]
    for third in range(3):
        rows.filter(F.col("alert_id") % 3 == third).write.mode("append").parquet(source)
        run = streams.start_results(
            alert_source.stream_alerts(spark, source, schema=rows.schema, file_format="parquet"),
            lambda batch: results.score_alerts(batch, as_of=AS_OF, keep=("alert_id", "ts")),
            path, scratch_path(spark, "stream-state"), once=True, buffer_path=kept,
            buffer_order=order, key="alert_id",
        )
        run.awaitTermination()
    page = streams.read_buffer(spark, kept, order, 0)
    return page.select("alert_id", "source_ip", "event_type", "severity", "label", "status")


@query
def stream_metrics(spark, sf_dir):
    """Rows read, repeats dropped and rows written, over the batches of a stream."""
    path = scratch_path(spark, "stream-results")
    run = streams.start_results(
        _alert_stream(spark, sf_dir, 4, copies=3),
        lambda batch: results.score_alerts(batch, as_of=AS_OF, keep=KEEP),
        path, scratch_path(spark, "stream-state"), once=True, key="alert_id",
    )
    run.awaitTermination()
    return streams.batch_metrics(spark, path).agg(
        F.count("*").alias("batches"),
        *[F.sum(n).alias(n) for n in ("polled", "repeats", "written")],
    )


@query
def stream_polled(spark, sf_dir):
    """Alerts polled from JSON files an eighth at a time, however the files are cut."""
    source, path = scratch_path(spark, "alert-lines"), scratch_path(spark, "stream-results")
    state, rows = scratch_path(spark, "poll-state"), tables.alerts(spark, sf_dir)
    rows.drop("alert_id", "ts").write.json(source)
    cap = max(1, -(-rows.count() // 8))
    polled = polling.poll_alerts(spark, source, f"{state}/ledger", f"{state}/checkpoint", cap)
    run = streams.start_results(
        polled, lambda batch: results.score_alerts(batch, as_of=AS_OF, keep=("id",)), path,
        f"{state}/checkpoint", every="0 seconds",
    )
    run.processAllAvailable()
    streams.stop(run)
    found = spark.read.parquet(path)
    sizes = found.groupBy("batch_id").agg((F.count("*") <= cap).alias("within_cap"))
    return found.join(sizes, "batch_id").select("id", "severity", "label", "status", "within_cap")


@query
def replay_paced(spark, sf_dir):
    """Batch number of every replayed row; batches follow the row numbers."""
    source, path = scratch_path(spark, "paced-rows"), scratch_path(spark, "paced")
    rows = tables.raw_logs(spark, sf_dir)
    rows.repartitionByRange("seq").write.parquet(source)
    stored = spark.read.parquet(source)
    top = stored.agg(F.max("seq")).first()[0]
    size = -(-(top + 1) // 4)
    run = streams.start_paced(stored, path, scratch_path(spark, "stream-state"), size, 4,
                              every="0 seconds")
    while run.isActive and (run.lastProgress or {"batchId": -1})["batchId"] < 4:
        run.awaitTermination(1)
    streams.stop(run)
    return spark.read.parquet(path).select("seq", F.col("batch_id").cast("int").alias("batch"))
