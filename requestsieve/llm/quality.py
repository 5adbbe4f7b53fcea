"""Quality rules per document and per host.

Each document is measured in built-in functions, within its row. A host (the document's source)
is judged by its documents' rule failures: its failure rate is shrunk towards the rate of all
hosts by a beta prior fitted to them, and a host whose shrunk rate is above `host_limit` loses
all its documents. The limit is high, so that only hosts that give next to nothing else go;
clean documents of ordinary hosts stay.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from requestsieve.llm.common import WORD, lookup, small_side, whole_text, written

WINDOW = 3
MIN_WORDS = 50
REPEAT_PERCENT = 50
HOST_LIMIT = 0.9
METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeated_places(pairs: Column) -> Column:
    """Places, in order, of windows that stand next to an equal hash in sorted (hash, place).

    Written as one pass that keeps the entry before; an entry equal to it adds both places.
    """
    return F.sort_array(
        F.array_distinct(
            F.flatten(
                F.transform(
                    pairs,
                    lambda p, k: F.when(
                        (k > 0) & (F.get(pairs, k - 1)["h"] == p["h"]),
                        F.array(F.get(pairs, k - 1)["i"], p["i"]),
                    ).otherwise(F.array().cast("array<int>")),
                )
            )
        )
    )


def measure(docs: DataFrame, into: str = "__rs_metrics") -> DataFrame:
    """`docs` with a struct column of the metrics of each whole text (null: no words).

    Windows are compared by a 64-bit hash within one text. Texts without a repeated window
    skip the sort; for the others time grows as n log n.
    """
    text = whole_text()
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    last = F.size("__rs_words") - WINDOW
    windows = F.when(
        last >= 0,
        F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.xxhash64(*[F.get("__rs_words", i + k) for k in range(WINDOW)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    pairs = F.when(
        F.size(F.array_distinct("__rs_windows")) < F.size("__rs_windows"),
        F.array_sort(F.transform("__rs_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )
    covered = F.aggregate(
        F.transform(
            "__rs_places",
            lambda i, k: F.least(
                F.lit(WINDOW), F.coalesce(F.get("__rs_places", k + 1) - i, F.lit(WINDOW))
            ),
        ),
        F.lit(0),
        lambda total, n: total + n,
    )
    columns = docs.columns
    return (
        docs.withColumns({"__rs_words": words, "__rs_lines": lines})
        .withColumn("__rs_windows", windows)
        .withColumn("__rs_pairs", pairs)
        .withColumn("__rs_places", _repeated_places(F.col("__rs_pairs")))
        .select(
            *columns,
            F.struct(
                F.size("__rs_words").cast("long").alias("n_words"),
                F.length(F.array_join("__rs_words", "")).cast("long").alias("word_chars"),
                F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
                (F.size("__rs_lines") - F.size(F.array_distinct("__rs_lines")))
                .cast("long")
                .alias("n_dup_lines"),
                F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
            ).alias(into),
        )
    )


def base_failed(metrics: str = "__rs_metrics") -> Column:
    m = F.col(metrics)
    return (m["n_words"] < MIN_WORDS) | (
        100 * m["n_repeat_words"] > REPEAT_PERCENT * m["n_words"]
    )


def host_key(source: str = "source") -> Column:
    """Documents without a source are a host of their own."""
    name = F.col(source).cast("string")
    return F.when(name.isNull(), "1").otherwise(F.concat(F.lit("0"), name))


def host_verdicts(hosts: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """`hosts` (__rs_host, documents, failures) with the shrunk rate and `host_ok`.

    The prior is a beta distribution with the mean and the spread of the hosts' rates (method of
    moments, with the spread due to sampling taken off, and worth at most 1,000 documents). Where
    the hosts show no spread of their own, the prior has that full weight.
    """
    rate = F.col("failures") / F.col("documents")
    every = Window.partitionBy()
    mean = F.sum("failures").over(every) / F.sum("documents").over(every)
    seen = F.avg((rate - F.col("__rs_mean")) * (rate - F.col("__rs_mean"))).over(every)
    chance = F.avg(F.col("__rs_mean") * (1 - F.col("__rs_mean")) / F.col("documents")).over(every)
    spread = F.col("__rs_seen") - F.col("__rs_chance")
    strength = F.when(spread <= 0, 1000.0).otherwise(
        F.least(
            F.lit(1000.0),
            F.greatest(F.lit(0.0), F.col("__rs_mean") * (1 - F.col("__rs_mean")) / spread - 1),
        )
    )
    shrunk = (F.col("failures") + F.col("__rs_mean") * F.col("__rs_strength")) / (
        F.col("documents") + F.col("__rs_strength")
    )
    return (
        hosts.withColumn("__rs_mean", mean)
        .withColumns({"__rs_seen": seen, "__rs_chance": chance})
        .withColumn("__rs_strength", strength)
        .withColumn("shrunk_rate", shrunk)
        .withColumn("host_ok", F.col("shrunk_rate") <= host_limit)
        .select("__rs_host", "documents", "failures", "shrunk_rate", "host_ok")
    )


def host_table(measured: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """One row per host with its verdict, written. Failures are summed per task before the
    shuffle, so a host with a third of all rows is not one task."""
    return written(
        host_verdicts(
            measured.groupBy("__rs_host").agg(
                F.count(F.lit(1)).alias("documents"),
                F.sum(F.col("__rs_failed").cast("long")).alias("failures"),
            ),
            host_limit,
        ),
        "hosts",
    )


def judge(measured: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """Rows with __rs_host and __rs_failed, joined with their host's verdict.

    `measured` is read twice, so it should be written. Large hosts' verdicts are broadcast. The
    prior is a window over one row per host.
    """
    hosts = host_table(measured, host_limit)
    values = ["shrunk_rate", "host_ok"]
    return lookup(measured, hosts, "__rs_host", "documents", values, F.col("__rs_id"))


def assess(docs: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """Per row: doc_id, the metrics, base_failed, kept, and the host's shrunk failure rate.

    Null and empty texts have no words and fail. Repeated rows each count. No rows give none.
    """
    rows = measure(docs.select("doc_id", "text", "source")).select(
        "doc_id",
        F.coalesce(F.col("doc_id"), F.lit(0)).alias("__rs_id"),
        host_key().alias("__rs_host"),
        F.col("__rs_metrics.*"),
        base_failed().alias("__rs_failed"),
    )
    judged = judge(written(rows, "metrics"), host_limit)
    return judged.select(
        "doc_id",
        *METRICS,
        F.col("__rs_failed").alias("base_failed"),
        (~F.col("__rs_failed") & F.col("host_ok")).alias("kept"),
        F.col("shrunk_rate").alias("host_rate"),
    )


def keep_good(docs: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """The rows of `docs` that pass, with their own columns.

    The rows are written once with their verdict, so texts are measured once; they are not
    shuffled by host unless very many hosts are rejected.
    """
    rows = measure(docs).withColumns(
        {
            "__rs_host": host_key(),
            "__rs_failed": base_failed(),
        }
    )
    rows = written(rows.drop("__rs_metrics"), "measured")
    hosts = host_table(rows.select("__rs_host", "__rs_failed"), host_limit)
    bad = hosts.filter(~F.col("host_ok")).select("__rs_host")
    good = rows.filter(~F.col("__rs_failed"))
    return good.join(small_side(bad), "__rs_host", "left_anti").select(docs.columns)
