"""Model answers: prompt text, normalisation, fallback and confidence."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from requestsieve.functions.text import to_fixed, true_false
from requestsieve.settings import CLASSES, DEFAULTS, Settings

# What a verdict says when a model gives no usable answer.
PRIMARY_UNAVAILABLE = "AI classification unavailable, defaulting to suspicious"
SECONDARY_UNAVAILABLE = "OpenAI fallback unavailable, defaulting to suspicious"

VERDICT_TYPE = "struct<score: double, class: string, source: string, reason: string>"


def verdict(score: Column, cls: Column, source: str, reason: Column) -> Column:
    return F.struct(
        score.cast("double").alias("score"),
        cls.alias("class"),
        F.lit(source).alias("source"),
        reason.cast("string").alias("reason"),
    )


def no_verdict() -> Column:
    return F.lit(None).cast(VERDICT_TYPE)


def build_prompt() -> Column:
    """Question for a text model; needs the signals and `rate`."""
    facts = {
        "client address": F.col("ip"),
        "country": F.col("country"),
        "user agent": F.concat(F.lit("'"), F.col("user_agent"), F.lit("'")),
        "path": F.concat(F.lit("'"), F.col("path"), F.lit("'")),
        "sends accept-language": true_false(F.col("has_accept_lang")),
        "sends referer": true_false(F.col("has_referer")),
        "requests in this minute": F.col("rate").cast("string"),
        "over TLS": true_false(F.col("has_tls")),
    }
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in facts.items()]
    return F.concat_ws(
        "\n",
        F.lit("Decide whether a person or a program sent this web request."),
        *lines,
        F.lit(
            "Answer with one flat JSON object and nothing else. Its keys: class (one of "
            + ", ".join(CLASSES)
            + "), score (0 for surely a person to 1 for surely a program), reason (a sentence)."
        ),
    )


# Names of the numeric variant types, as Spark reports them.
_NUMBER_TYPES = "^(BIGINT|DECIMAL|DOUBLE|FLOAT)"


def with_model_verdict(
    rows: DataFrame, text: str, name: str, fallback_reason: str, where: Column | None = None
) -> DataFrame:
    """Add `name`, the verdict in the model's answer `text`; NULL where `where` fails.

    The JSON runs from the first '{' to the next '}'. Without one, or if it is not strict
    JSON, the verdict is the fallback.

    Each answer is parsed once: the document and its members are columns of their own, and the
    verdict comes out of a one-element generator, because a filter on a plain column would be
    pushed below it and repeat the work.
    """
    wanted = F.lit(True) if where is None else where
    braces = F.nullif(F.regexp_extract(F.when(wanted, F.col(text)), r"\{[^}]*\}", 0), F.lit(""))
    parsed = rows.withColumn("_answer_wanted", wanted).withColumn(
        "_answer_json", F.try_parse_json(braces)
    )

    def member(key: str) -> Column:
        return F.try_variant_get("_answer_json", f"$.{key}", "variant")

    keys = ("class", "score", "reason")
    members = parsed.withColumns({f"_answer_{key}": member(key) for key in keys})
    typed = members.withColumns(
        {f"_answer_{key}_type": F.schema_of_variant(f"_answer_{key}") for key in keys}
    )

    def value(key: str, kind: str) -> Column:
        return F.try_variant_get(f"_answer_{key}", "$", kind)

    is_text = F.col("_answer_class_type") == "STRING"
    is_number = F.col("_answer_score_type").rlike(_NUMBER_TYPES)
    typed = typed.withColumns(
        {
            "_answer_claimed": F.when(is_text, value("class", "string")),
            "_answer_number": F.when(is_number, value("score", "double")),
        }
    )
    claimed, number = F.col("_answer_claimed"), F.col("_answer_number")
    score = (
        F.when(number.isNull(), 0.5)
        .when(number < 0.0, 0.0)
        .when(number > 1.0, 1.0)
        .otherwise(number)
    )
    cls = F.when(claimed.isin(*CLASSES), claimed).otherwise("SUSPICIOUS")
    found = verdict(score, cls, "AI", _reason_text(value))
    fallback = verdict(F.lit(0.5), F.lit("SUSPICIOUS"), "AI", F.lit(fallback_reason))
    parsed_or_not = F.when(F.col("_answer_json").isNotNull(), found).otherwise(fallback)
    verdicts = F.when(F.col("_answer_wanted"), parsed_or_not)
    kept = [c for c in rows.columns if c != name]
    return typed.select(*kept, F.explode(F.array(verdicts)).alias(name))


def _reason_text(value: Callable[[str, str], Column]) -> Column:
    """The reason as text; missing, null, false, zero and empty ones are the empty text."""
    kind = F.col("_answer_reason_type")
    is_zero = kind.rlike(_NUMBER_TYPES) & (value("reason", "double") == 0.0)
    is_false = (kind == "BOOLEAN") & ~value("reason", "boolean")
    nothing = kind.isNull() | (kind == "VOID") | is_zero | is_false
    # Lists do not cast to text, so they keep their JSON form. An object cannot occur here.
    as_text = F.coalesce(value("reason", "string"), F.to_json("_answer_reason"))
    return F.when(kind == "STRING", value("reason", "string")).when(nothing, "").otherwise(as_text)


def is_low_confidence(score: Column, settings: Settings = DEFAULTS) -> Column:
    low, high = settings.low_confidence
    return score.between(low, high)


def escalated(primary: Column, secondary: Column, settings: Settings = DEFAULTS) -> Column:
    """The second verdict where the first is unsure and the second is not."""
    takes_second = is_low_confidence(primary["score"], settings) & ~is_low_confidence(
        secondary["score"], settings
    )
    return F.when(takes_second, secondary).otherwise(primary)


def vector_reason(similarity: Column) -> Column:
    # Fixed value: wording of the reason.
    return F.concat(
        F.lit("Behavioral fingerprint matches known bot pattern (similarity: "),
        to_fixed(similarity, 3),
        F.lit(")"),
    )


def decide(score: Column, cls: Column, source: Column) -> dict[str, Column]:
    """What is answered to the client. Statuses and messages."""
    is_bot = cls == "BOT"
    return {
        "action": F.when(is_bot, "BLOCK").otherwise("PASS"),
        "status": F.when(is_bot, 403).otherwise(200),
        "warning": F.when(cls == "SUSPICIOUS", "Request flagged as suspicious"),
        "error": F.when(is_bot, "Access denied"),
        "error_reason": F.when(is_bot, "Request classified as automated bot traffic."),
        "score_text": to_fixed(score, 2),
        "class": cls,
        "source": source,
    }
