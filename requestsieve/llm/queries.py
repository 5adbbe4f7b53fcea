"""The operators as queries over the whole `documents` table: name -> (spark, sf_dir) -> rows."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from requestsieve.llm import (
    bpe,
    exact_dedup,
    infill,
    mixing,
    near_dedup,
    packing,
    phrases,
    quality,
    secrets,
    sharding,
    substring_dedup,
    token_files,
    toxicity,
)
from requestsieve.llm.common import documents
from requestsieve.session import configure, shared_folder


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = [rule.kind for rule in secrets.BASE]
    spans = F.col("__rs_spans")
    in_base = F.filter(spans, lambda s: s["kind"].isin(base))
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return secrets.scan(documents(spark, sf_dir)).select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in base],
        F.sha2(secrets.as_text(in_base), 256).alias("base_sha256"),
        secrets.as_text(spans).alias("spans"),
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact_dedup.DigestIndex(spark, shared_folder(spark, "index"))
    return exact_dedup.mark(documents(spark, sf_dir), index)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = configure(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.classify(documents(spark, sf_dir), labels)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(documents(spark, sf_dir), path)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(documents(spark, sf_dir)).drop("host_rate")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "token-ids")
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_files.read(token_files.write(documents(spark, sf_dir), folder, path), folder)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(documents(spark, sf_dir))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir)).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = bpe.decode(bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), path), path)
    decimal = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(decimal, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = infill.restore(infill.transform(documents(spark, sf_dir).select("doc_id", "text")))
    return rows.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scan,
        op2_exact_dedup,
        op3_toxicity,
        op4_packing,
        op5_quality_rules,
        op6_token_files,
        op7_substring_dedup,
        op8_mixing,
        op9_near_dedup,
        op10_sharding,
        op11_phrases,
        op12_bpe,
        op13_fill_in_middle,
        pipeline,
    )
}

ORACLES = {
    "op2_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
        FROM d JOIN g USING (t)""",
    "op5_quality_rules": r"""
        WITH w AS (
          SELECT doc_id, source, coalesce(text, '') AS t,
            regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
          FROM documents),
        windows AS (
          SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) > 2),
        hits AS (
          SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i:i + 2]) AS n FROM windows),
        covered AS (
          SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
          FROM hits, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id),
        lines AS (
          SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w),
        dup AS (
          SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines
          WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
        m AS (
          SELECT w.doc_id, source, CAST(len(words) AS BIGINT) AS n_words,
            CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT)
              AS word_chars,
            CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
            coalesce(n_dup_lines, 0) AS n_dup_lines,
            coalesce(n_repeat_words, 0) AS n_repeat_words
          FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id)),
        f AS (
          SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
        hosts AS (
          SELECT source, CAST(count(*) AS DOUBLE) AS n,
            CAST(count(*) FILTER (base_failed) AS DOUBLE) AS k FROM f GROUP BY source),
        mean AS (SELECT sum(k) / sum(n) AS mu FROM hosts),
        prior AS (
          SELECT mu, avg((k / n - mu) * (k / n - mu)) - avg(mu * (1 - mu) / n) AS spread
          FROM hosts, mean GROUP BY mu),
        weight AS (
          SELECT mu, CASE WHEN spread <= 0 THEN 1000
            ELSE least(1000, greatest(0, mu * (1 - mu) / spread - 1)) END AS s FROM prior),
        verdict AS (SELECT source, (k + mu * s) / (n + s) <= 0.9 AS ok FROM hosts, weight)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
          NOT base_failed AND ok AS kept
        FROM f JOIN verdict ON f.source IS NOT DISTINCT FROM verdict.source""",
    "op7_substring_dedup": r"""
        WITH w AS (
          SELECT doc_id,
            regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        windows AS (
          SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS h
          FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w
                WHERE len(words) >= 50)),
        again AS (
          SELECT doc_id, i FROM (
            SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS first_id FROM windows)
          WHERE first_id < doc_id),
        gone AS (
          SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM again),
        places AS (
          SELECT doc_id, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS word FROM w),
        kept AS (
          SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n_kept
          FROM places ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
          CAST(len(words) - coalesce(n_kept, 0) AS BIGINT) AS n_removed,
          sha256(coalesce(kept, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)""",
    "op8_mixing": r"""
        WITH d AS (
          SELECT doc_id, source,
            CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
            CAST('0x' || substr(md5('mix:' || CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h
          FROM documents),
        laid AS (
          SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h, doc_id) - size AS start FROM d),
        s AS (
          SELECT source, sum(size) AS source_size, 2.0::DOUBLE * sum(size) AS cap,
            [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
          FROM d GROUP BY source),
        levels AS (
          SELECT *, cap / weight AS ratio,
            (1.5::DOUBLE * sum(source_size) OVER ()
              - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST
                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
          FROM s),
        t AS (
          SELECT source, source_size, CASE WHEN ratio <= level THEN cap ELSE weight *
            (SELECT level FROM levels WHERE ratio > level ORDER BY ratio, source NULLS LAST LIMIT 1)
            END AS target
          FROM levels),
        w AS (
          SELECT *, CAST(least(2 * source_size, floor(target + 0.5)) AS BIGINT) AS words FROM t)
        SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
          CAST(CASE WHEN source_size = 0 THEN 0 ELSE size * (words // source_size)
            + greatest(0, least(size, words % source_size - start)) END AS BIGINT) AS taken
        FROM laid JOIN w ON laid.source IS NOT DISTINCT FROM w.source""",
    "op11_phrases": r"""
        WITH pieces AS (
          SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[.,;:!?\x0A-\x0D]')) AS piece
          FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
        totals AS (SELECT lang, sum(len(words)) AS n FROM w GROUP BY lang),
        places AS (
          SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w),
        grams AS (
          SELECT lang, m, words[i:i + m - 1] AS g
          FROM places, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE i + m - 1 <= len(words)),
        f AS (
          SELECT lang, m, g, count(*) AS a FROM grams GROUP BY lang, m, g HAVING count(*) >= 30),
        cuts AS (
          SELECT lang, m, g, a, unnest(range(1, m)) AS k FROM f WHERE m > 1),
        scored AS (
          SELECT c.*, x.a AS l, y.a AS r,
            CAST(CAST(c.a AS HUGEINT) * 2000000 // (x.a + y.a) AS BIGINT) AS score
          FROM cuts c JOIN f x ON x.lang = c.lang AND x.g = c.g[1:k]
            JOIN f y ON y.lang = c.lang AND y.g = c.g[k + 1:]),
        weakest AS (
          SELECT * FROM scored
          QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
        inner_parts AS (
          SELECT DISTINCT lang, g AS longer, a, unnest([g[i:i + z - 1] FOR i IN range(1, m - z + 2)]) AS g
          FROM f, (SELECT unnest([2, 3]) AS z) WHERE z < m),
        most AS (SELECT lang, g, max(a) AS most FROM inner_parts GROUP BY lang, g),
        kept AS (
          SELECT w.* FROM weakest w LEFT JOIN most USING (lang, g)
          WHERE most IS NULL OR 100 * most < 80 * a),
        ranked AS (
          SELECT *, array_to_string(g, ' ') AS phrase, row_number() OVER (
            PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank
          FROM kept)
        SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
        FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""",
}
