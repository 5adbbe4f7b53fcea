"""Batch classification of requests, cheapest stage first.

1. Find cache sessions on the small per-minute table, which partial aggregation makes.
2. Rank rows per (ip, minute) to get at the misses, one per session, and keep those.
3. Resolve only the misses: fingerprint, heuristics, model, second model.
4. Carry each session's verdict to its hits by way of the per-minute table, on the same
   partitioning that ranks the rows: the rows are shuffled once for rate, session and verdict.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from requestsieve.functions.heuristics import heuristic_score, heuristic_verdict
from requestsieve.functions.verdicts import VERDICT_TYPE, decide, no_verdict
from requestsieve.operators.activity import (
    Ranking,
    drop_blocks,
    join_slots,
    minute_activity,
    rank_rows,
    split_trackable,
    spread_for_ranking,
)
from requestsieve.operators.distinct import join_results, per_distinct
from requestsieve.operators.fingerprints import (
    embed_hashing,
    vector_digest,
    vector_verdicts,
    with_signal_text,
)
from requestsieve.operators.models import Model, model_verdicts
from requestsieve.operators.reputation import (
    SESSION_KEY,
    session_minutes,
    slot_columns,
    with_session_hits,
)
from requestsieve.session import durable, stored
from requestsieve.settings import DEFAULTS, Settings


@dataclass(frozen=True)
class Fingerprints:
    """How misses get vectors: `embed` adds `vector` to a table of distinct `key` values.

    The default key is the behaviour text, so each distinct text is embedded once. With
    `index` None nothing matches. `keep_vectors` gives `vector` to the misses that a model
    decides, for storing: only those become fingerprints.
    """

    index: DataFrame | None
    key: str = "signal_text"
    embed: Callable[[DataFrame], DataFrame] = embed_hashing
    keep_vectors: bool = False


NO_FINGERPRINTS = Fingerprints(None)


def vector_stage(
    misses: DataFrame, fingerprints: Fingerprints, settings: Settings = DEFAULTS
) -> tuple[DataFrame, DataFrame | None]:
    """Add `vector_verdict` to misses, NULL where no known bot behaves alike, and the key.

    Also returns the vectors by digest, if they are to be kept. Misses carry `_digest` instead,
    and keys of equal vectors, told by its 128 bits, search once.
    """
    key, index = fingerprints.key, fingerprints.index
    if index is None and not fingerprints.keep_vectors:
        return misses.withColumn("vector_verdict", no_verdict()), None
    kept: list[DataFrame] = []

    def verdict_per_key(keys: DataFrame) -> DataFrame:
        embedded = stored(
            fingerprints.embed(keys).select(key, "vector", vector_digest(F.col("vector")).alias("_digest"))
        )
        vectors = embedded.groupBy("_digest").agg(F.first("vector").alias("vector"))
        kept.append(vectors)
        by_key = embedded.select(key, "_digest")
        if index is None:
            return by_key.withColumn("vector_verdict", no_verdict())
        found = vector_verdicts(vectors.withColumnRenamed("_digest", "query_id"), index, settings)
        # A key that comes with several vectors has the best of their matches.
        rank = F.struct(-F.col("vector.score"), "match_id")
        best = (
            by_key.join(found.withColumnRenamed("query_id", "_digest"), "_digest")
            .groupBy(key)
            .agg(F.min_by("vector", rank).alias("vector_verdict"))
        )
        return by_key.join(best, key, "left") if fingerprints.keep_vectors else best

    misses = durable(misses)  # read twice below
    if key == "signal_text":
        misses = with_signal_text(misses)
    judged = per_distinct(misses, key, verdict_per_key)
    return judged, kept[0] if fingerprints.keep_vectors else None


def resolve(
    misses: DataFrame,
    primary: Model,
    secondary: Model | None = None,
    fingerprints: Fingerprints = NO_FINGERPRINTS,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Add `verdict` to cache misses: fingerprint, then heuristics, then models.

    Rows that the first two stages leave open are divided from the decided ones, so models and
    their stored answers meet open rows only, and only those get `vector`, if vectors are kept.
    """
    early = F.coalesce(
        F.col("vector_verdict"),
        heuristic_verdict(heuristic_score(settings), settings).cast(VERDICT_TYPE),
    )
    judged, vectors = vector_stage(misses, fingerprints, settings)
    staged = durable(judged.withColumn("verdict", early).drop("vector_verdict"))
    decided = staged.filter("verdict IS NOT NULL")
    open_rows = staged.filter("verdict IS NULL").drop("verdict")
    answered = model_verdicts(open_rows, primary, secondary, settings).withColumnRenamed("ai", "verdict")
    if vectors is not None:
        answered = join_results(answered, "_digest", vectors).drop("_digest")
        kind = vectors.schema["vector"].dataType
        decided = decided.drop("_digest").withColumn("vector", F.lit(None).cast(kind))
    return decided.unionByName(answered)


@dataclass(frozen=True)
class Tracked:
    """Requests with rate and session columns, and what it takes to join more per minute.

    `entries` are what was remembered of their clients before, if anything was asked for.
    """

    rows: DataFrame
    slots: DataFrame
    ranking: Ranking
    entries: DataFrame | None = None


def track(
    requests: DataFrame,
    settings: Settings = DEFAULTS,
    remembered: Callable[[DataFrame], DataFrame] | None = None,
) -> Tracked:
    """Rates and sessions of the requests that have an ip and a time.

    `remembered` gives the stored entries of the clients (distinct `ip`) it is handed; rates,
    sessions and hits go on from them.
    """
    requests, _ = split_trackable(requests)
    minutes, entries = minute_activity(requests), None
    if remembered is not None:
        minutes = durable(minutes)
        entries = durable(remembered(minutes.select("ip").distinct()))
    slots = durable(session_minutes(minutes, settings, entries))
    ranking = spread_for_ranking(requests, slots, settings)
    rows = with_session_hits(rank_rows(ranking, slot_columns(slots)))
    return Tracked(rows, slots, ranking, entries)


def misses_of(tracked: Tracked) -> DataFrame:
    return drop_blocks(tracked.rows).filter("is_miss")


def row_verdict(is_miss: Column, verdict: Column) -> dict[str, Column]:
    """A miss keeps its verdict; a hit reuses score and class, has source CACHE, no reason."""
    return {
        "score": verdict["score"],
        "class": verdict["class"],
        "source": F.when(is_miss, verdict["source"]).otherwise("CACHE"),
        "reason": F.when(is_miss, verdict["reason"]),
    }


def carry_verdict(tracked: Tracked, verdicts: DataFrame) -> DataFrame:
    """Give every row of a session the verdict of the session's miss.

    `verdicts` has (ip, session_start, verdict), one row per session. Rows meet the verdict
    at their minute or block, so a session with most of the rows is no hot key.
    """
    per_minute = (
        tracked.slots.select("ip", "minute", "session_start")
        .join(verdicts.select(*SESSION_KEY, "verdict"), SESSION_KEY)
        .drop("session_start")
    )
    rows = drop_blocks(join_slots(tracked.rows, tracked.ranking, per_minute))
    return rows.withColumns(row_verdict(F.col("is_miss"), F.col("verdict"))).drop("verdict")


def classify(
    requests: DataFrame,
    primary: Model,
    secondary: Model | None = None,
    fingerprints: Fingerprints = NO_FINGERPRINTS,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Signals in (see `schemas.SIGNALS`), one classified row per request out.

    Adds minute, rate, session_start, hits, is_miss, score, class, source, reason. Requests
    without ip or time cannot be classified; `split_trackable` gives them.
    """
    tracked = track(requests, settings)
    resolved = resolve(misses_of(tracked), primary, secondary, fingerprints, settings)
    return carry_verdict(tracked, resolved)


def decisions(classified: DataFrame) -> DataFrame:
    columns = decide(F.col("score"), F.col("class"), F.col("source"))
    return classified.select("request_id", *[c.alias(n) for n, c in columns.items()])
