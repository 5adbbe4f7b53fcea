"""Model verdicts as batch joins.

A model is either a table of stored answers (request_id, response) or a function from
distinct prompts (one column, `prompt`) to (prompt, response), typically a `mapInPandas` call.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from requestsieve.functions.verdicts import (
    PRIMARY_UNAVAILABLE,
    SECONDARY_UNAVAILABLE,
    build_prompt,
    escalated,
    is_low_confidence,
    with_model_verdict,
)
from requestsieve.operators.distinct import per_distinct
from requestsieve.session import durable
from requestsieve.settings import DEFAULTS, Settings

Scorer = Callable[[DataFrame], DataFrame]
Model = DataFrame | Scorer


def score_distinct_prompts(rows: DataFrame, scorer: Scorer) -> DataFrame:
    """Add `response` to rows with a `prompt`; each distinct prompt is sent once.

    Rows whose prompt is NULL ask nothing.
    """
    return per_distinct(rows, "prompt", scorer)


def _ask(rows: DataFrame, model: Model, name: str) -> DataFrame:
    """Add the model's text about each of the rows as column `name`."""
    if isinstance(model, DataFrame):
        # Answers to other requests are left out before anything is grouped; then one answer for
        # each request, the least text, so that no row is multiplied.
        asked = model.join(rows.select("request_id"), "request_id", "left_semi")
        answers = asked.groupBy("request_id").agg(F.min("response").alias(name))
        return rows.join(answers, "request_id", "left")
    prompted = rows.withColumn("prompt", build_prompt())
    return score_distinct_prompts(prompted, model).drop("prompt").withColumnRenamed(
        "response", name
    )


def model_verdicts(
    rows: DataFrame,
    primary: Model,
    secondary: Model | None = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Add `ai`, the models' verdict, to rows that no earlier stage has decided.

    The second model, if there is one, sees only rows the first is unsure about; these are
    divided from the rest, so its answers are joined with no others. `rows` is read more than
    once and should be materialised.
    """
    asked = with_model_verdict(
        _ask(rows, primary, "_primary_text"), "_primary_text", "ai", PRIMARY_UNAVAILABLE
    ).drop("_primary_text")
    if secondary is None:
        return asked
    asked = durable(asked)
    unsure = F.coalesce(is_low_confidence(F.col("ai.score"), settings), F.lit(False))
    again = with_model_verdict(
        _ask(asked.filter(unsure), secondary, "_secondary_text"),
        "_secondary_text",
        "_second",
        SECONDARY_UNAVAILABLE,
    ).withColumn("ai", escalated(F.col("ai"), F.col("_second"), settings))
    return asked.filter(~unsure).unionByName(again.drop("_secondary_text", "_second"))


def normalize_responses(
    responses: DataFrame, fallback_reason: str = PRIMARY_UNAVAILABLE
) -> DataFrame:
    """One verdict per stored answer."""
    verdicts = with_model_verdict(responses, "response", "verdict", fallback_reason)
    return verdicts.select("request_id", "verdict.*")


def escalate(
    primary: DataFrame, secondary: DataFrame | None, settings: Settings = DEFAULTS
) -> DataFrame:
    """Final model verdicts from two verdict tables keyed by request_id."""
    columns = ["score", "class", "source", "reason"]
    first = primary.select("request_id", F.struct(*columns).alias("first"))
    if secondary is None:
        return first.select("request_id", "first.*")
    second = secondary.select("request_id", F.struct(*columns).alias("second"))
    unsure = first.filter(is_low_confidence(F.col("first.score"), settings))
    answered = unsure.select("request_id").join(second, "request_id")
    return (
        first.join(answered, "request_id", "left")
        .select(
            "request_id",
            escalated(F.col("first"), F.col("second"), settings).alias("v"),
        )
        .select("request_id", "v.*")
    )
