"""Every operator as a query over the sample tables: name -> (spark, sf_dir) -> DataFrame."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from requestsieve.functions.heuristics import (
    heuristic_score,
    heuristic_verdict,
    rate_band,
    rule_hits,
)
from requestsieve.functions.signals import extract_signals, signal_text
from requestsieve.functions.verdicts import (
    SECONDARY_UNAVAILABLE,
    build_prompt,
    is_low_confidence,
)
from requestsieve.operators.activity import (
    live_windows,
    lookup_counts,
    request_rate,
    window_counts,
)
from requestsieve.operators.fingerprints import (
    embed_hashing,
    fingerprint_topk,
    new_fingerprints,
    upsert_fingerprints,
    vector_verdicts,
)
from requestsieve.operators.models import (
    escalate,
    normalize_responses,
    score_distinct_prompts,
)
from requestsieve.operators.reputation import (
    active_reputation,
    cache_sessions,
    reputation_sessions,
    upsert_reputation,
)
from requestsieve.plans import analytics, cascade, outputs
from requestsieve.session import shared_folder, stored
from requestsieve.settings import Settings
from requestsieve.sources import log, requests, samples, stores
from requestsieve.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]

HOURS = 72
NOW = samples.NOW_MS
# A moment on the dense timeline, and one in the middle of the sparse one.
DENSE_NOW = samples.START_MS + 300_000
MIDDLE = samples.START_MS + 15 * 86_400_000


# --- sources and sinks ------------------------------------------------------------------


def read_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "requests")
    samples.raw_requests(spark, sf_dir).write.parquet(path)
    return requests.read_requests(spark, path).select(
        "request_id",
        "ts_ms",
        "method",
        "url",
        "cf_country",
        "cf_tls_version",
        F.size("headers").alias("header_count"),
    )


def classifiable_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.classifiable(samples.raw_requests(spark, sf_dir)).select(
        "request_id", "method", "url"
    )


def log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "log")
    log.append_log(samples.log_in(spark, sf_dir), path)
    return log.read_log(spark, path, analytics.since_ms(HOURS, NOW), keep_day=False)


def validate_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = log.validate_log(samples.log_with_errors(spark, sf_dir))
    return checked.select("request_id", F.array_join("errors", ",").alias("errors"))


def upsert_reputation_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    logged = samples.log_in(spark, sf_dir)
    touches = cache_sessions(logged).select(
        "ip", "score", "class", "hits", F.col("ts_ms").alias("last_seen")
    )
    earlier = upsert_reputation(None, touches.filter(F.col("last_seen") <= MIDDLE))
    return upsert_reputation(earlier, touches.filter(F.col("last_seen") > MIDDLE))


def upsert_fingerprints_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = samples.query_vectors(spark, sf_dir)
    logged = samples.vector_keys(samples.log_in(spark, sf_dir), queries)
    vectors = queries.withColumnRenamed("query_id", "vector_key")
    rows = logged.join(vectors, "vector_key")
    earlier = new_fingerprints(rows.filter(F.col("ts_ms") <= MIDDLE))
    # The second half writes some ids of the first again, with new vectors.
    fresh = new_fingerprints(rows.withColumn("vector", F.transform("vector", lambda x: -x)))
    both = upsert_fingerprints(earlier, fresh)
    return both.select(
        "id",
        "ip",
        "class",
        "score",
        "ts_ms",
        "country",
        F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 6).alias("value_sum"),
    )


# --- signals ----------------------------------------------------------------------------


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_signals(samples.raw_requests(spark, sf_dir))


# --- rates ------------------------------------------------------------------------------


def minute_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return request_rate(samples.requests_dense(spark, sf_dir)).select(
        "request_id", "ip", "minute", "rate"
    )


def window_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_counts(samples.requests_dense(spark, sf_dir))


def window_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = window_counts(samples.requests_dense(spark, sf_dir))
    next_minute = counts.select("ip", (F.col("minute") + 1).alias("minute"))
    return lookup_counts(counts, next_minute)


def window_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_windows(samples.requests_dense(spark, sf_dir), DENSE_NOW)


def rate_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = request_rate(samples.requests_dense(spark, sf_dir))
    return rated.groupBy(rate_band(F.col("rate")).alias("points")).agg(
        F.count(F.lit(1)).alias("n")
    )


# --- reputation -------------------------------------------------------------------------


def cache_sessions_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache_sessions(samples.requests_in(spark, sf_dir)).select(
        "request_id", "ip", "session_start", "hits", "is_miss"
    )


def reputation_sessions_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reputation_sessions(samples.requests_in(spark, sf_dir))


def carry_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracked = cascade.track(samples.log_in(spark, sf_dir))
    own = F.struct(
        "score", "class", "source", F.lit(None).cast("string").alias("reason")
    ).alias("verdict")
    verdicts = tracked.rows.filter("is_miss").select("ip", "session_start", own)
    return cascade.carry_verdict(tracked, verdicts).select(
        "request_id", "score", "class", "source"
    )


def active_reputation_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    logged = samples.log_in(spark, sf_dir)
    verdicts = (
        cache_sessions(logged).filter("is_miss").select("ip", "session_start", "score", "class")
    )
    return active_reputation(logged, verdicts, NOW)


# --- fingerprints -----------------------------------------------------------------------


def signal_text_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = request_rate(samples.requests_dense(spark, sf_dir))
    return rated.select("request_id", signal_text().alias("signal_text"))


def embed_hashing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of each behaviour text's vector that are not zero."""
    texts = signal_text_query(spark, sf_dir).select("signal_text").distinct()
    return (
        embed_hashing(texts)
        .select("signal_text", F.posexplode("vector").alias("place", "weight"))
        .filter(F.col("weight") != 0)
        .withColumn("weight", F.round(F.col("weight").cast("double"), 6))
    )


def fingerprint_topk_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint_topk(
        samples.query_vectors(spark, sf_dir), samples.fingerprint_index(spark, sf_dir)
    )
    return found.withColumn("similarity", F.round("similarity", 6))


# As if the index were too large to be broadcast, and its cells too large for one task.
CELLS = Settings(
    broadcast_elements=1, pivots=64, vectors_per_shard=2_000, queries_per_shard=2_000
)


def fingerprint_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search by cells over all embeddings: equal to comparing all pairs."""
    found = fingerprint_topk(
        samples.query_vectors(spark, sf_dir),
        samples.fingerprint_index(spark, sf_dir),
        settings=CELLS,
    )
    return found.withColumn("similarity", F.round("similarity", 6))


def vector_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts_of(spark, sf_dir, Settings())


def vector_verdict_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the floor that a verdict needs, few cells are visited."""
    return _verdicts_of(spark, sf_dir, CELLS)


def _verdicts_of(spark: SparkSession, sf_dir: str, settings: Settings) -> DataFrame:
    queries = samples.query_vectors(spark, sf_dir)
    found = vector_verdicts(queries, samples.fingerprint_index(spark, sf_dir), settings)
    return found.select(
        "query_id",
        "match_id",
        F.round("vector.score", 6).alias("score"),
        "vector.class",
        "vector.source",
        "vector.reason",
    )


# --- heuristics -------------------------------------------------------------------------


def heuristic_score_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = request_rate(samples.requests_dense(spark, sf_dir))
    return rated.select("request_id", heuristic_score().alias("score"))


def heuristic_verdict_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = request_rate(samples.requests_dense(spark, sf_dir))
    return (
        rated.select("request_id", heuristic_verdict(heuristic_score()).alias("v"))
        .filter(F.col("v").isNotNull())
        .select("request_id", "v.score", "v.class", "v.source")
    )


def rule_hits_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_hits(request_rate(samples.requests_dense(spark, sf_dir)))


# --- models -----------------------------------------------------------------------------


def build_prompt_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = request_rate(samples.requests_dense(spark, sf_dir))
    return rated.select("request_id", build_prompt().alias("prompt"))


def answer_by_length(prompts: DataFrame) -> DataFrame:
    """A stand-in for a model: the answer depends on the prompt's length."""
    answers = samples.ANSWERS

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            picks = batch["prompt"].str.len() % len(answers)
            yield batch.assign(response=[answers[i] for i in picks])

    return prompts.mapInPandas(answer, "prompt string, response string")


def score_distinct_prompts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompted = build_prompt_query(spark, sf_dir)
    return score_distinct_prompts(prompted, answer_by_length).select("request_id", "response")


def normalize_responses_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_responses(samples.responses(spark, sf_dir))


def low_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = normalize_responses(samples.responses(spark, sf_dir))
    return verdicts.select("request_id", "score").filter(is_low_confidence(F.col("score")))


def escalate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = normalize_responses(samples.responses(spark, sf_dir))
    second = normalize_responses(
        samples.responses(spark, sf_dir, secondary=True), SECONDARY_UNAVAILABLE
    )
    return escalate(first, second)


# --- cascade ----------------------------------------------------------------------------


def sample_fingerprints(spark: SparkSession, sf_dir: str) -> cascade.Fingerprints:
    """Vectors by key instead of an embedding of the behaviour text."""
    vectors = samples.query_vectors(spark, sf_dir).withColumnRenamed("query_id", "vector_key")
    return cascade.Fingerprints(
        samples.fingerprint_index(spark, sf_dir),
        key="vector_key",
        embed=lambda keys: keys.join(vectors, "vector_key"),
    )


def _keyed(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    return samples.vector_keys(rows, samples.table(spark, sf_dir, "embeddings"))


def _classified(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    return cascade.classify(
        _keyed(spark, sf_dir, rows),
        samples.responses(spark, sf_dir),
        samples.responses(spark, sf_dir, secondary=True),
        sample_fingerprints(spark, sf_dir),
    )


def classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, samples.requests_in(spark, sf_dir)).select(
        "request_id",
        "ip",
        "rate",
        "hits",
        F.round("score", 6).alias("score"),
        "class",
        "source",
        "reason",
    )


def classify_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long sessions: nearly all rows take a carried verdict."""
    return _classified(spark, sf_dir, samples.requests_dense(spark, sf_dir)).select(
        "request_id",
        "ip",
        "rate",
        "hits",
        F.round("score", 6).alias("score"),
        "class",
        "source",
        "reason",
    )


def decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.decisions(samples.log_in(spark, sf_dir))


def write_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the sinks, then read them back."""
    folder = shared_folder(spark, "outputs")
    outputs.write_outputs(
        stored(_keyed(spark, sf_dir, samples.requests_in(spark, sf_dir))),
        folder,
        samples.responses(spark, sf_dir),
        samples.responses(spark, sf_dir, secondary=True),
        sample_fingerprints(spark, sf_dir),
    )
    return _written(spark, folder)


def _written(spark: SparkSession, folder: str) -> DataFrame:
    """Per client: rows of the log, its entry, and the number of its fingerprints."""
    logged = log.read_log(spark, f"{folder}/log").groupBy("ip").agg(
        F.count(F.lit(1)).alias("logged"),
        F.count_if(F.col("source") == "CACHE").alias("cached"),
    )
    entries = stores.read_reputation(spark, f"{folder}/reputation").select(
        "ip", "class", "hits", "last_seen"
    )
    prints = (
        stores.read_fingerprints(spark, f"{folder}/fingerprints")
        .groupBy("ip")
        .agg(F.count(F.lit(1)).alias("fingerprints"))
    )
    return (
        logged.join(entries, "ip", "full")
        .join(prints, "ip", "left")
        .withColumn("fingerprints", F.coalesce("fingerprints", F.lit(0)))
    )


# Times that divide the dense timeline into batches: within a minute, within sessions.
DENSE_CUTS = (60_000, 200_500, 200_501, 480_250)


def _in_batches(
    spark: SparkSession, sf_dir: str, rows: DataFrame, cuts: list[int], folder: str
) -> outputs.Sinks:
    """Run the cascade over the rows before the first cut, then up to the next one, and so on."""
    sinks = outputs.Sinks.at(spark, folder)
    rows = stored(rows)  # each batch reads its part several times
    edges = [None, *cuts, None]
    for batch_id, (since, until) in enumerate(zip(edges, edges[1:], strict=False)):
        # A row without a time comes with the last batch.
        after = F.lit(True) if since is None else F.col("ts_ms") >= since
        before = F.lit(True) if until is None else F.col("ts_ms") < until
        lacking = F.col("ts_ms").isNull() & F.lit(until is None)
        outputs.run_batch(
            rows.filter(F.coalesce(after & before, F.lit(False)) | lacking),
            batch_id,
            sinks,
            samples.responses(spark, sf_dir),
            samples.responses(spark, sf_dir, secondary=True),
            sample_fingerprints(spark, sf_dir),
        )
    return sinks


def classify_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense timeline in batches that cut minutes and sessions: equal to a single run."""
    folder = shared_folder(spark, "incremental")
    rows = _keyed(spark, sf_dir, samples.requests_dense(spark, sf_dir))
    _in_batches(spark, sf_dir, rows, [samples.START_MS + c for c in DENSE_CUTS], folder)
    return log.read_log(spark, f"{folder}/log", keep_day=False).select(
        "request_id", "ip", F.round("score", 6).alias("score"), "class", "source"
    )


def incremental_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What batches of ten days leave in the sinks: equal to what a single run leaves."""
    folder = shared_folder(spark, "incremental")
    rows = _keyed(spark, sf_dir, samples.requests_in(spark, sf_dir))
    day = 86_400_000
    _in_batches(
        spark, sf_dir, rows, [samples.START_MS + 10 * day, samples.START_MS + 20 * day], folder
    )
    return _written(spark, folder)


def classify_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests without client or time and answers that come twice: all are accounted for."""
    folder = shared_folder(spark, "dirty")
    answers = samples.responses(spark, sf_dir)
    outputs.write_outputs(
        _keyed(spark, sf_dir, samples.requests_dirty(spark, sf_dir)),
        folder,
        answers.unionByName(answers),
        samples.responses(spark, sf_dir, secondary=True),
        sample_fingerprints(spark, sf_dir),
    )
    logged = log.read_log(spark, f"{folder}/log", keep_day=False)
    errors = F.array_join("errors", ",")
    good = logged.select("request_id", F.round("score", 6).alias("score"), "class", F.lit("").alias("errors"))
    bad = log.read_rejected(spark, f"{folder}/log").select("request_id", "score", "class", errors.alias("errors"))
    return good.unionByName(bad)


def classified_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From raw signals to a dashboard view in one plan."""
    classified = _classified(spark, sf_dir, samples.requests_in(spark, sf_dir))
    return analytics.by_country(classified, 24 * 31, NOW)


def known_bots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of how one agent behaves on its first request of a minute."""
    rows = samples.requests_in(spark, sf_dir).filter(F.col("user_agent") == "curl/8.5.0")
    texts = rows.withColumn("rate", F.lit(1).cast("long")).select(signal_text().alias("id")).distinct()
    return embed_hashing(texts, "id").select("id", F.col("vector").alias("values"), F.lit("BOT").alias("class"))


def _decided(classified: DataFrame) -> DataFrame:
    decided = cascade.decisions(classified).drop("class", "source")
    shown = classified.select("request_id", "ip", "class", "source")
    return decided.join(shown, "request_id").select(
        "request_id", "ip", "class", "source", "action", "status", "score_text"
    )


def raw_to_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From raw requests to decisions, by the behaviour text's own vectors."""
    path = shared_folder(spark, "requests")
    samples.raw_requests(spark, sf_dir).write.parquet(path)
    raw = requests.classifiable(requests.read_requests(spark, path))
    classified = cascade.classify(
        extract_signals(raw),
        samples.responses(spark, sf_dir),
        samples.responses(spark, sf_dir, secondary=True),
        cascade.Fingerprints(known_bots(spark, sf_dir)),
    )
    return _decided(classified)


def raw_to_decision_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream of raw requests, some files at a time, into the log."""
    folder = shared_folder(spark, "raw-stream")
    raw = samples.raw_requests(spark, sf_dir)
    each = max(2, spark.sparkContext.defaultParallelism)
    raw.repartitionByRange(3 * each, "ts_ms", "request_id").write.parquet(f"{folder}/in")
    first = samples.responses(spark, sf_dir)
    second = samples.responses(spark, sf_dir, secondary=True)
    # The files of the sample come in the order of their time, a third to a micro-batch.
    files = sorted(raw_files(spark, f"{folder}/in"))
    prints = cascade.Fingerprints(stored(known_bots(spark, sf_dir)))
    for k in range(0, len(files), each):
        spark.read.parquet(*files[k : k + each]).write.mode("append").parquet(f"{folder}/arrived")
        source = requests.stream_requests(spark, f"{folder}/arrived")
        signals_of = extract_signals(requests.classifiable(source))
        jobs.drain(
            jobs.classify_stream(signals_of, f"{folder}/out", f"{folder}/checkpoint", first, second, prints)
        )
    return _decided(log.read_log(spark, f"{folder}/out/log", keep_day=False))


def raw_files(spark: SparkSession, path: str) -> list[str]:
    return spark.read.parquet(path).inputFiles()


# --- analytics --------------------------------------------------------------------------


def _ranged(view: Callable[[DataFrame, int, int], DataFrame]) -> Query:
    return lambda spark, sf_dir: view(samples.log_in(spark, sf_dir), HOURS, NOW)


def recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.recent(samples.log_in(spark, sf_dir))


def analytics_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    bundle = analytics.analytics_bundle(samples.log_in(spark, sf_dir), HOURS, NOW)
    return analytics.bundle_rows(bundle)


def parsed_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log's row count for each range a dashboard may ask for, odd ones included."""
    logged = samples.log_in(spark, sf_dir)
    asked = ("1h", "6h", "24h", "72h", "0h", "7d", "abc", "-5h", "h12", "")
    counts = logged.agg(
        *[
            F.count_if(
                F.col("ts_ms") > analytics.since_ms(analytics.parse_range(text), NOW)
            ).alias(text)
            for text in asked
        ]
    )
    return counts.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(t).alias("asked"), F.col(f"`{t}`").alias("n"))
                    if t
                    else F.struct(F.lit("").alias("asked"), F.col("``").alias("n"))
                    for t in asked
                ]
            )
        ).alias("r")
    ).select("r.*")


def _over(view: Callable[[DataFrame], DataFrame], source: Query) -> Query:
    return lambda spark, sf_dir: view(source(spark, sf_dir))


def top_bot_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = analytics.top_bot_share(_ranged(analytics.top_bot_ips)(spark, sf_dir))
    return shares.withColumn("share", F.round("share", 6))


# --- streams ----------------------------------------------------------------------------

# The sample timeline in three parts, streamed one after the other with restarts between.
# The last one holds all that is left, rows without a time too.
SLICES = (samples.START_MS + 10 * 86_400_000, samples.START_MS + 20 * 86_400_000, None)


def _run_in_slices(
    rows: DataFrame, path: str, start: Callable[[DataFrame], DataStreamWriter]
) -> None:
    """Append one slice at a time to the source folder and let the stream catch up."""
    spark = rows.sparkSession
    since = None
    for until in SLICES:
        after = F.lit(True) if since is None else ~(F.col("ts_ms") < since)
        before = F.lit(True) if until is None else F.col("ts_ms") < until
        part = rows.filter(F.coalesce(after, F.lit(until is None)) & F.coalesce(before, F.lit(False)))
        part.write.mode("append").parquet(path)
        source = spark.readStream.schema(rows.schema).parquet(path)
        jobs.drain(start(source))
        since = until


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates and sessions of a stream, over three runs of it."""
    folder = shared_folder(spark, "stream-sessions")

    def start(source: DataFrame) -> DataStreamWriter:
        return jobs.track_stream(source, f"{folder}/out", f"{folder}/checkpoint")

    _run_in_slices(samples.requests_in(spark, sf_dir), f"{folder}/in", start)
    return jobs.tracked_table(spark, f"{folder}/out").read().select(
        "request_id", "ip", "rate", "session_start", "hits", "is_miss"
    )


def stream_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole cascade as a stream, matched with a fixed index."""
    folder = shared_folder(spark, "stream-classify")
    first = samples.responses(spark, sf_dir)
    second = samples.responses(spark, sf_dir, secondary=True)
    prints = sample_fingerprints(spark, sf_dir)

    def start(source: DataFrame) -> DataStreamWriter:
        return jobs.classify_stream(
            source, f"{folder}/out", f"{folder}/checkpoint", first, second, prints
        )

    rows = _keyed(spark, sf_dir, samples.requests_in(spark, sf_dir))
    _run_in_slices(rows, f"{folder}/in", start)
    return log.read_log(spark, f"{folder}/out/log", keep_day=False).select(
        "request_id", "ip", F.round("score", 6).alias("score"), "class", "source"
    )


def stream_analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dashboard views over tallies that a stream keeps up to date."""
    folder = shared_folder(spark, "stream-analytics")

    def start(source: DataFrame) -> DataStreamWriter:
        return jobs.tally_stream(source, f"{folder}/out", f"{folder}/checkpoint")

    _run_in_slices(samples.log_in(spark, sf_dir), f"{folder}/in", start)
    log = samples.log_in(spark, sf_dir)
    return analytics.bundle_rows(jobs.live_bundle(spark, f"{folder}/out", log, HOURS, NOW))


QUERIES: dict[str, Query] = {
    "read_requests": read_requests,
    "classifiable_requests": classifiable_requests,
    "log_scan": log_scan,
    "validate_log": validate_log,
    "upsert_reputation": upsert_reputation_query,
    "upsert_fingerprints": upsert_fingerprints_query,
    "signals": signals,
    "minute_rate": minute_rate,
    "window_counts": window_counts_query,
    "window_lookup": window_lookup,
    "window_expiry": window_expiry,
    "rate_band": rate_bands,
    "cache_sessions": cache_sessions_query,
    "reputation_sessions": reputation_sessions_query,
    "carry_verdict": carry_verdict,
    "active_reputation": active_reputation_query,
    "signal_text": signal_text_query,
    "embed_hashing": embed_hashing_query,
    "fingerprint_topk": fingerprint_topk_query,
    "fingerprint_cells": fingerprint_cells,
    "vector_verdict": vector_verdict,
    "vector_verdict_cells": vector_verdict_cells,
    "heuristic_score": heuristic_score_query,
    "heuristic_verdict": heuristic_verdict_query,
    "rule_hits": rule_hits_query,
    "build_prompt": build_prompt_query,
    "score_distinct_prompts": score_distinct_prompts_query,
    "normalize_responses": normalize_responses_query,
    "low_confidence": low_confidence,
    "escalate": escalate_query,
    "classify": classify,
    "classify_dense": classify_dense,
    "decide": decide,
    "write_outputs": write_outputs,
    "classify_incremental": classify_incremental,
    "incremental_entries": incremental_entries,
    "classify_dirty": classify_dirty,
    "classified_by_country": classified_by_country,
    "raw_to_decision": raw_to_decision,
    "raw_to_decision_stream": raw_to_decision_stream,
    "parse_range": parsed_ranges,
    "total": _ranged(analytics.total),
    "class_breakdown": _ranged(analytics.class_breakdown),
    "source_breakdown": _ranged(analytics.source_breakdown),
    "top_bot_ips": _ranged(analytics.top_bot_ips),
    "by_country": _ranged(analytics.by_country),
    "timeline": _ranged(analytics.timeline),
    "recent": recent,
    "analytics_bundle": analytics_bundle,
    "top_bot_share": top_bot_share,
    "recent_display": _over(analytics.recent_display, recent),
    "timeline_labels": _over(analytics.timeline_labels, _ranged(analytics.timeline)),
    "country_chart": _over(analytics.country_chart, _ranged(analytics.by_country)),
    "stream_sessions": stream_sessions,
    "stream_classify": stream_classify,
    "stream_analytics": stream_analytics,
}
