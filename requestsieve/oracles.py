"""The catalog's queries in ANSI-style SQL (DuckDB), over the same tables."""

from requestsieve.functions.heuristics import BOT_AGENTS, PROBED_PATHS
from requestsieve.functions.verdicts import PRIMARY_UNAVAILABLE, SECONDARY_UNAVAILABLE
from requestsieve.sources.samples import ANSWERS, NOW_MS, SPEED_UP, START_MS

HOUR_MS = 3_600_000
TTL_MS = 3_600_000
SINCE = NOW_MS - 72 * HOUR_MS
MIDDLE = START_MS + 15 * 86_400_000
DENSE_NOW = START_MS + 300_000


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _any_of(column: str, parts: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), {_text(p)})" for p in parts) + ")"


# Event times have microseconds; floor them, as epoch_ms would round.
EVENTS = """
ev AS (
  SELECT e.*, epoch_us(e.ts) // 1000 AS ms, p.url,
    CASE e.event_id % 8 WHEN 0 THEN '' WHEN 1 THEN 'curl/8.5.0' WHEN 2 THEN 'python-requests/2.31'
      WHEN 3 THEN 'Googlebot/2.1' ELSE 'Mozilla/5.0 (X11; Linux x86_64)' END AS agent,
    '10.0.' || CAST(e.user_id // 256 AS VARCHAR) || '.' || CAST(e.user_id % 256 AS VARCHAR) AS user_ip
  FROM events e JOIN pages p ON p.page_id = e.event_id % (SELECT count(*) FROM pages)
)"""

REQUESTS_IN = (
    EVENTS
    + """,
requests_in AS (
  SELECT event_id AS request_id, ms AS ts_ms, user_ip AS ip,
    CASE user_id % 7 WHEN 0 THEN 'US' WHEN 1 THEN 'DE' WHEN 2 THEN 'FR' WHEN 3 THEN 'IN'
      WHEN 4 THEN 'BR' WHEN 5 THEN 'CN' ELSE 'XX' END AS country,
    agent AS user_agent,
    CASE event_type WHEN 'error' THEN '/wp-login.php' WHEN 'signup' THEN '/.env?x=1'
      ELSE regexp_replace(url, '^[a-z]+://[^/]+', '') END AS path,
    event_id % 3 <> 0 AS has_accept_lang, event_id % 5 <> 0 AS has_referer,
    user_id % 4 <> 0 AS has_tls,
    concat_ws(',', CASE WHEN event_id % 3 <> 0 THEN 'accept-language' END,
      CASE WHEN event_id % 5 <> 0 THEN 'referer' END, 'user-agent') AS header_keys
  FROM ev
)"""
)

DENSE = (
    REQUESTS_IN
    + f""",
requests_dense AS (
  SELECT * REPLACE (
    {START_MS} + (ts_ms - {START_MS}) // {SPEED_UP} AS ts_ms,
    CASE WHEN request_id % 10 < 3 THEN '192.0.2.' || CAST(request_id % 10 AS VARCHAR) ELSE ip END AS ip)
  FROM requests_in
)"""
)

RAW = (
    EVENTS
    + """,
raw0 AS (
  SELECT event_id AS i, user_id AS u, ms, url, agent, user_ip,
    regexp_extract(url, '^[a-z]+://[^/]+') AS origin FROM ev
),
raw AS (
  SELECT i AS request_id, ms AS ts_ms,
    CASE WHEN i % 31 = 0 THEN 'OPTIONS' ELSE 'GET' END AS method,
    CASE WHEN i % 13 = 0 THEN origin || '/health'
      WHEN i % 17 = 0 THEN origin || '/analytics?range=6h'
      WHEN i % 19 = 0 THEN origin WHEN i % 23 = 0 THEN origin || '?x=1'
      WHEN i % 29 = 0 THEN url || '?' ELSE url END AS url,
    CASE WHEN i % 4 = 0 THEN NULL WHEN i % 9 = 0 THEN '' ELSE user_ip END AS h_ip,
    CASE WHEN i % 5 < 3 THEN '203.0.113.' || CAST(u % 200 AS VARCHAR) || ', 10.1.1.1' END AS h_xff,
    CASE WHEN i % 3 = 0 THEN 'GB' END AS h_country,
    nullif(agent, '') AS h_agent,
    CASE WHEN i % 11 = 0 THEN 'second/1.0' END AS h_agent2,
    CASE WHEN i % 3 = 1 THEN 'en' WHEN i % 3 = 2 THEN '' END AS h_lang,
    CASE WHEN i % 5 <> 0 THEN url END AS h_referer,
    CASE WHEN i % 2 = 0 THEN CASE u % 7 WHEN 0 THEN 'US' WHEN 1 THEN 'DE' WHEN 2 THEN 'FR'
      WHEN 3 THEN 'IN' WHEN 4 THEN 'BR' WHEN 5 THEN 'CN' END END AS cf_country,
    CASE u % 4 WHEN 0 THEN '' WHEN 1 THEN 'TLSv1.3' END AS cf_tls_version
  FROM raw0
),
raw_path AS (
  SELECT *, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1) AS rest FROM raw
),
raw_full AS (
  SELECT *, CASE WHEN ends_with(rooted, '?') AND instr(rooted, '?') = length(rooted)
      THEN left(rooted, length(rooted) - 1) ELSE rooted END AS path
  FROM (SELECT *, CASE WHEN rest LIKE '/%' THEN rest ELSE '/' || rest END AS rooted FROM raw_path)
)"""
)


SIGNALS = """
SELECT request_id, ts_ms,
  coalesce(nullif(h_ip, ''), nullif(h_xff, ''), '0.0.0.0') AS ip,
  coalesce(nullif(cf_country, ''), nullif(h_country, ''), 'XX') AS country,
  concat_ws(', ', h_agent, h_agent2) AS user_agent, path,
  coalesce(h_lang, '') <> '' AS has_accept_lang, coalesce(h_referer, '') <> '' AS has_referer,
  coalesce(cf_tls_version, '') <> '' AS has_tls,
  concat_ws(',', CASE WHEN h_lang IS NOT NULL THEN 'accept-language' END,
    CASE WHEN h_ip IS NOT NULL THEN 'cf-connecting-ip' END,
    CASE WHEN h_country IS NOT NULL THEN 'cf-ipcountry' END,
    CASE WHEN h_referer IS NOT NULL THEN 'referer' END,
    CASE WHEN h_agent IS NOT NULL OR h_agent2 IS NOT NULL THEN 'user-agent' END,
    CASE WHEN h_xff IS NOT NULL THEN 'x-forwarded-for' END) AS header_keys
FROM raw_full"""


def _responses(name: str, selector: str) -> str:
    cases = " ".join(f"WHEN {n} THEN {_text(a)}" for n, a in enumerate(ANSWERS))
    return (
        f"{name} AS (SELECT event_id AS request_id, "
        f"CASE {selector} {cases} END AS response FROM events)"
    )


RESPONSES = _responses("responses", "event_id % 10")
RESPONSES2 = _responses("responses2", "(event_id // 10) % 10")


def _normalized(name: str, source: str, fallback: str) -> str:
    """Verdicts from answers: strict JSON between the first '{' and the next '}'."""
    return f"""
{name} AS (
  SELECT request_id,
    CASE WHEN ok AND json_type(doc, '$.score') IN ('UBIGINT', 'BIGINT', 'DOUBLE')
      THEN CASE WHEN num < 0 THEN 0.0 WHEN num > 1 THEN 1.0 ELSE num END ELSE 0.5 END AS score,
    CASE WHEN ok AND json_type(doc, '$.class') = 'VARCHAR'
        AND json_extract_string(doc, '$.class') IN ('LEGITIMATE', 'SUSPICIOUS', 'BOT')
      THEN json_extract_string(doc, '$.class') ELSE 'SUSPICIOUS' END AS class,
    'AI' AS source,
    CASE WHEN ok THEN coalesce(json_extract_string(doc, '$.reason'), '')
      ELSE {_text(fallback)} END AS reason
  FROM (
    SELECT *, CASE WHEN ok THEN TRY_CAST(json_extract_string(doc, '$.score') AS DOUBLE) END AS num
    FROM (
      SELECT request_id, braces <> '' AND json_valid(braces) AS ok,
        CASE WHEN braces <> '' AND json_valid(braces) THEN braces ELSE '{{}}' END AS doc
      FROM (SELECT request_id, regexp_extract(response, '\\{{[^}}]*\\}}') AS braces FROM {source})
    )
  )
)"""


NORMAL1 = RESPONSES + "," + _normalized("first", "responses", PRIMARY_UNAVAILABLE)
NORMAL2 = RESPONSES2 + "," + _normalized("second", "responses2", SECONDARY_UNAVAILABLE)

ESCALATED = """
escalated AS (
  SELECT f.request_id,
    CASE WHEN swap THEN s.score ELSE f.score END AS score,
    CASE WHEN swap THEN s.class ELSE f.class END AS class,
    'AI' AS source,
    CASE WHEN swap THEN s.reason ELSE f.reason END AS reason
  FROM (
    SELECT f.request_id, f.score BETWEEN 0.4 AND 0.6 AND NOT s.score BETWEEN 0.4 AND 0.6 AS swap
    FROM first f JOIN second s USING (request_id)
  ) d JOIN first f USING (request_id) JOIN second s USING (request_id)
)"""

LOG_IN = (
    REQUESTS_IN
    + """,
log_in AS (
  SELECT request_id, ip, country, path, user_agent, CAST(request_id % 101 AS DOUBLE) / 100 AS score,
    CASE request_id % 5 WHEN 0 THEN 'BOT' WHEN 1 THEN 'BOT' WHEN 2 THEN 'SUSPICIOUS'
      ELSE 'LEGITIMATE' END AS class,
    CASE request_id % 3 WHEN 0 THEN 'CACHE' WHEN 1 THEN 'HEURISTIC' ELSE 'AI' END AS source, ts_ms
  FROM requests_in
)"""
)


def _rated(source: str) -> str:
    return f"""
rated AS (
  SELECT *, ts_ms // 60000 AS minute,
    row_number() OVER (PARTITION BY ip, ts_ms // 60000 ORDER BY ts_ms, request_id) AS rate
  FROM {source}
)"""


def _sessions(source: str) -> str:
    """Rows with their session: a gap of the time-to-live or more starts a new one."""
    return f"""
gaps AS (
  SELECT *, ts_ms - lag(ts_ms) OVER (PARTITION BY ip ORDER BY ts_ms, request_id) AS gap FROM {source}
),
numbered AS (
  SELECT *, gap IS NULL OR gap >= {TTL_MS} AS is_miss,
    sum(CASE WHEN gap IS NULL OR gap >= {TTL_MS} THEN 1 ELSE 0 END)
      OVER (PARTITION BY ip ORDER BY ts_ms, request_id ROWS UNBOUNDED PRECEDING) AS session_no
  FROM gaps
),
sessions AS (
  SELECT *, min(ts_ms) OVER (PARTITION BY ip, session_no) AS session_start,
    max(ts_ms) OVER (PARTITION BY ip, session_no) AS session_end,
    row_number() OVER (PARTITION BY ip, session_no ORDER BY ts_ms, request_id) AS hits
  FROM numbered
)"""


POINTS = f"""
points AS (
  SELECT *,
    CAST({_any_of("user_agent", BOT_AGENTS)} AS INT) AS bot_agent,
    CAST(user_agent = '' AS INT) AS empty_agent,
    CAST(NOT has_accept_lang AS INT) AS no_language,
    CAST({_any_of("path", PROBED_PATHS)} AS INT) AS probed_path,
    CAST(rate > 60 AS INT) AS rate_over_limit,
    CAST(rate > 30 AND rate <= 60 AS INT) AS rate_over_half,
    CAST(NOT has_referer AND NOT has_accept_lang AS INT) AS no_referer_no_language
  FROM rated
),
scored AS (
  SELECT *, least(100, 50 * bot_agent + 40 * empty_agent + 20 * no_language + 30 * probed_path
    + 40 * rate_over_limit + 20 * rate_over_half + 10 * no_referer_no_language) AS points
  FROM points
)"""

VECTORS = """
vecs AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
blends AS (
  SELECT a.vec_id AS query_id,
    list_transform(list_zip(a.v, b.v), lambda p: a.w * p[1] + (1 - a.w) * p[2]) AS q
  FROM (SELECT *, CASE vec_id % 4 WHEN 0 THEN 0.9::DOUBLE WHEN 1 THEN 0.72::DOUBLE
      WHEN 2 THEN 0.65::DOUBLE ELSE 0.5::DOUBLE END AS w FROM vecs) a
  JOIN vecs b ON b.vec_id = (a.vec_id + 1) % (SELECT count(*) FROM embeddings)
),
pairs AS (
  SELECT query_id, lpad(CAST(vec_id AS VARCHAR), 12, '0') AS id,
    round(list_cosine_similarity(q, v), 12) AS similarity
  FROM blends, vecs WHERE label % 2 = 0
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM pairs
),
vector_hits AS (
  SELECT query_id, id AS match_id, similarity AS score, 'BOT' AS class, 'VECTOR' AS source,
    'Behavioral fingerprint matches known bot pattern (similarity: '
      || format('{:.3f}', similarity) || ')' AS reason
  FROM ranked WHERE rank = 1 AND similarity >= 0.92
)"""


BY_KEY = "v.query_id = s.request_id % (SELECT count(*) FROM embeddings)"


def _classified(source: str, vectors: str = VECTORS, matched: str = BY_KEY) -> str:
    return (
        f"{NORMAL1}, {NORMAL2}, {ESCALATED}, {_rated(source)}, {POINTS}, {vectors}, "
        + _sessions("scored")
        + f""",
own AS (
  SELECT s.*, v.query_id IS NOT NULL AS by_vector,
    CASE WHEN v.query_id IS NOT NULL THEN v.score WHEN points >= 70 THEN points / 100.0
      ELSE a.score END AS own_score,
    CASE WHEN v.query_id IS NOT NULL OR points >= 70 THEN 'BOT' ELSE a.class END AS own_class,
    CASE WHEN v.query_id IS NOT NULL THEN 'VECTOR' WHEN points >= 70 THEN 'HEURISTIC'
      ELSE 'AI' END AS own_source,
    CASE WHEN v.query_id IS NOT NULL THEN v.reason WHEN points >= 70 THEN NULL
      ELSE a.reason END AS own_reason
  FROM sessions s
  JOIN escalated a USING (request_id)
  LEFT JOIN vector_hits v ON {matched}
),
classified AS (
  SELECT request_id, ip, country, ts_ms, rate, hits, session_end,
    first_value(own_score) OVER w AS score, first_value(own_class) OVER w AS class,
    CASE WHEN is_miss THEN own_source ELSE 'CACHE' END AS source,
    CASE WHEN is_miss THEN own_reason END AS reason
  FROM own
  WINDOW w AS (PARTITION BY ip, session_no ORDER BY ts_ms, request_id)
)"""
    )


def _yes(flag: str) -> str:
    return f"CASE WHEN {flag} THEN 'true' ELSE 'false' END"


def _signal_text(rate: str) -> str:
    return f"""concat_ws(' | ', 'ua:' || user_agent, 'path:' || path,
  'lang:' || {_yes("has_accept_lang")}, 'ref:' || {_yes("has_referer")},
  'tls:' || {_yes("has_tls")}, 'rate:' || CAST({rate} AS VARCHAR), 'headers:' || header_keys)"""


def _embedded(name: str, source: str) -> str:
    """(text, place, n, length) of hashed token counts; `source` has distinct texts."""
    return f"""
{name}_counts AS (
  SELECT text, CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) % 384 AS place, count(*) AS n
  FROM (SELECT text, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM {source})
  GROUP BY text, place
),
{name} AS (
  SELECT *, CAST(n / sqrt(sum(n * n) OVER (PARTITION BY text)) AS FLOAT) AS weight FROM {name}_counts
)"""


# Behaviour texts against those of known bots, as sparse vectors.
TEXT_VECTORS = f"""
asked AS (SELECT DISTINCT {_signal_text("rate")} AS text FROM scored),
bots AS (SELECT DISTINCT {_signal_text("1")} AS text FROM requests_in WHERE user_agent = 'curl/8.5.0'),
{_embedded("asked_vectors", "asked")},
{_embedded("bot_vectors", "bots")},
norms AS (
  SELECT text, sqrt(sum(CAST(weight AS DOUBLE) * weight)) AS norm FROM (
    SELECT * FROM asked_vectors UNION SELECT * FROM bot_vectors) GROUP BY text
),
compared AS (
  SELECT a.text AS query_id, b.text AS id,
    round(sum(CAST(a.weight AS DOUBLE) * b.weight) / any_value(p.norm * q.norm), 12) AS similarity
  FROM asked_vectors a JOIN bot_vectors b USING (place)
    JOIN norms p ON p.text = a.text JOIN norms q ON q.text = b.text
  GROUP BY a.text, b.text
),
vector_hits AS (
  SELECT query_id, max(similarity) AS score, '' AS reason
  FROM compared GROUP BY query_id HAVING max(similarity) >= 0.92
)"""


CLASSIFY_COLUMNS = (
    "SELECT request_id, ip, rate, hits, round(score, 6) AS score, class, source, reason FROM classified"
)

IN_RANGE = f"ranged AS (SELECT * FROM log_in WHERE ts_ms > {SINCE})"
LOGGED = LOG_IN + "," + IN_RANGE

CLASS_COUNTS = """
SELECT c.class, count(r.class) AS n
FROM (VALUES ('LEGITIMATE'), ('SUSPICIOUS'), ('BOT')) c(class)
LEFT JOIN ranged r ON r.class = c.class GROUP BY c.class"""
SOURCE_COUNTS = """
SELECT s.source, count(r.source) AS n
FROM (VALUES ('CACHE'), ('HEURISTIC'), ('AI'), ('VECTOR')) s(source)
LEFT JOIN ranged r ON r.source = s.source GROUP BY s.source"""
TOP_IPS = """
SELECT ip, count(*) AS hits FROM ranged WHERE class = 'BOT' GROUP BY ip
ORDER BY hits DESC, ip LIMIT 10"""
BOT_LEGIT = """CAST(sum(CASE WHEN class = 'BOT' THEN 1 ELSE 0 END) AS BIGINT) AS bot,
  CAST(sum(CASE WHEN class = 'LEGITIMATE' THEN 1 ELSE 0 END) AS BIGINT) AS legit"""


def _by_country(source: str) -> str:
    return f"""
SELECT country, {BOT_LEGIT} FROM {source} GROUP BY country
ORDER BY bot DESC, country NULLS LAST LIMIT 20"""


TIMELINE = f"""
SELECT (ts_ms // 3600000) % 24 AS hour, {BOT_LEGIT} FROM ranged GROUP BY hour"""
RECENT = "SELECT * FROM log_in ORDER BY ts_ms DESC, request_id DESC LIMIT 50"


def _fixed(x: str, digits: int) -> str:
    """Decimal text, exact ties up: only odd multiples of 2^-(digits+1) are ties."""
    steps = f"(({x}) * {2 ** (digits + 1)})"
    return (
        f"format('{{:.{digits}f}}', ({x}) + CASE WHEN {steps} = floor({steps}) "
        f"AND {steps} % 2 = 1 THEN {10.0 ** -(digits + 1):.6f}::DOUBLE ELSE 0 END)"
    )


PROMPT = f"""
prompts AS (
  SELECT request_id, concat_ws(chr(10),
    'Decide whether a person or a program sent this web request.',
    'client address: ' || ip, 'country: ' || country,
    'user agent: ''' || user_agent || '''', 'path: ''' || path || '''',
    'sends accept-language: ' || {_yes("has_accept_lang")},
    'sends referer: ' || {_yes("has_referer")},
    'requests in this minute: ' || CAST(rate AS VARCHAR),
    'over TLS: ' || {_yes("has_tls")},
    'Answer with one flat JSON object and nothing else. Its keys: class (one of LEGITIMATE, '
      || 'SUSPICIOUS, BOT), score (0 for surely a person to 1 for surely a program), '
      || 'reason (a sentence).') AS prompt
  FROM rated
)"""

DENSE_RATED = DENSE + "," + _rated("requests_dense")

ORACLES: dict[str, str] = {
    "read_requests": f"""WITH {RAW}
SELECT request_id, ts_ms, method, url, cf_country, cf_tls_version,
  CAST(h_ip IS NOT NULL AS INT) + CAST(h_xff IS NOT NULL AS INT) + CAST(h_country IS NOT NULL AS INT)
  + CAST(h_agent IS NOT NULL AS INT) + CAST(h_agent2 IS NOT NULL AS INT)
  + CAST(h_lang IS NOT NULL AS INT) + CAST(h_referer IS NOT NULL AS INT) AS header_count
FROM raw""",
    "classifiable_requests": f"""WITH {RAW}
SELECT request_id, method, url FROM raw_full
WHERE method <> 'OPTIONS' AND split_part(path, '?', 1) NOT IN ('/analytics', '/health')""",
    "log_scan": f"WITH {LOGGED} SELECT * FROM ranged",
    "validate_log": f"""WITH {LOG_IN}
SELECT request_id, concat_ws(',',
  CASE WHEN request_id % 7 = 0 THEN 'ip' END, CASE WHEN request_id % 11 = 0 THEN 'score' END,
  CASE WHEN request_id % 13 = 0 OR request_id % 17 = 0 THEN 'class' END,
  CASE WHEN request_id % 19 = 0 OR request_id % 23 = 0 THEN 'source' END,
  CASE WHEN request_id % 29 = 0 THEN 'timestamp' END) AS errors
FROM log_in""",
    "upsert_reputation": f"""WITH {LOG_IN}, {_sessions("log_in")}
SELECT ip, score, class, hits, ts_ms AS last_seen FROM sessions
QUALIFY row_number() OVER (PARTITION BY ip ORDER BY ts_ms DESC, hits DESC) = 1""",
    "upsert_fingerprints": f"""WITH {LOG_IN}, {VECTORS}
SELECT 'ip_' || ip || '_' || CAST(ts_ms AS VARCHAR) AS id, ip, class, score, ts_ms, country,
  round(-list_sum(q), 6) AS value_sum
FROM log_in JOIN blends ON query_id = request_id % (SELECT count(*) FROM embeddings)
WHERE source = 'AI'
QUALIFY row_number() OVER (PARTITION BY ip, ts_ms ORDER BY request_id DESC) = 1""",
    "signals": f"WITH {RAW} {SIGNALS}",
    "minute_rate": f"WITH {DENSE_RATED} SELECT request_id, ip, minute, rate FROM rated",
    "window_counts": f"""WITH {DENSE}
SELECT ip, ts_ms // 60000 AS minute, count(*) AS n FROM requests_dense GROUP BY ALL""",
    "window_lookup": f"""WITH {DENSE},
counts AS (SELECT ip, ts_ms // 60000 AS minute, count(*) AS n FROM requests_dense GROUP BY ALL)
SELECT w.ip, w.minute + 1 AS minute, coalesce(c.n, 0) AS n
FROM counts w LEFT JOIN counts c ON c.ip = w.ip AND c.minute = w.minute + 1""",
    "window_expiry": f"""WITH {DENSE}
SELECT ip, ts_ms // 60000 AS minute, count(*) AS n, min(ts_ms) + 120000 AS expiry_ms
FROM requests_dense WHERE ts_ms <= {DENSE_NOW} GROUP BY ip, minute
HAVING min(ts_ms) + 120000 >= {DENSE_NOW}""",
    "rate_band": f"""WITH {DENSE_RATED}
SELECT CASE WHEN rate > 60 THEN 40 WHEN rate > 30 THEN 20 ELSE 0 END AS points, count(*) AS n
FROM rated GROUP BY points""",
    "cache_sessions": f"""WITH {REQUESTS_IN}, {_sessions("requests_in")}
SELECT request_id, ip, session_start, hits, is_miss FROM sessions""",
    "reputation_sessions": f"""WITH {REQUESTS_IN}, {_sessions("requests_in")}
SELECT ip, session_start, max(ts_ms) AS last_seen, count(*) AS hits
FROM sessions GROUP BY ip, session_start""",
    "carry_verdict": f"""WITH {LOG_IN}, {_sessions("log_in")}
SELECT request_id, first_value(score) OVER w AS score, first_value(class) OVER w AS class,
  CASE WHEN is_miss THEN source ELSE 'CACHE' END AS source
FROM sessions WINDOW w AS (PARTITION BY ip, session_no ORDER BY ts_ms, request_id)""",
    "active_reputation": f"""WITH {LOG_IN}, {_sessions("log_in")}
SELECT ip, arg_min(score, hits) AS score, arg_min(class, hits) AS class,
  max(hits) AS hits, max(ts_ms) AS last_seen
FROM sessions GROUP BY ip, session_no HAVING {NOW_MS} - max(ts_ms) < {TTL_MS}""",
    "signal_text": f"""WITH {DENSE_RATED}
SELECT request_id, {_signal_text("rate")} AS signal_text
FROM rated""",
    "embed_hashing": f"""WITH {DENSE_RATED},
texts AS (SELECT DISTINCT {_signal_text("rate")} AS text FROM rated),
{_embedded("vectors", "texts")}
SELECT text AS signal_text, CAST(place AS INT) AS place, round(CAST(weight AS DOUBLE), 6) AS weight
FROM vectors""",
    "fingerprint_topk": f"""WITH {VECTORS}
SELECT query_id, id, round(similarity, 6) AS similarity, CAST(rank AS INT) AS rank
FROM ranked WHERE rank <= 3""",
    "vector_verdict": f"""WITH {VECTORS}
SELECT query_id, match_id, round(score, 6) AS score, class, source, reason FROM vector_hits""",
    "heuristic_score": f"WITH {DENSE_RATED}, {POINTS} SELECT request_id, points AS score FROM scored",
    "heuristic_verdict": f"""WITH {DENSE_RATED}, {POINTS}
SELECT request_id, points / 100.0::DOUBLE AS score, 'BOT' AS class, 'HEURISTIC' AS source
FROM scored WHERE points >= 70""",
    "rule_hits": f"WITH {DENSE_RATED}, {POINTS} "
    + " UNION ALL ".join(
        f"SELECT '{rule}' AS rule, CAST(sum({rule}) AS BIGINT) AS hits, "
        f"CAST({points} * sum({rule}) AS BIGINT) AS points FROM points"
        for rule, points in (
            ("bot_agent", 50),
            ("empty_agent", 40),
            ("no_language", 20),
            ("probed_path", 30),
            ("rate_over_limit", 40),
            ("rate_over_half", 20),
            ("no_referer_no_language", 10),
        )
    ),
    "build_prompt": f"WITH {DENSE_RATED}, {PROMPT} SELECT request_id, prompt FROM prompts",
    "score_distinct_prompts": f"WITH {DENSE_RATED}, {PROMPT} SELECT request_id, CASE length(prompt) % 10 "
    + " ".join(f"WHEN {n} THEN {_text(a)}" for n, a in enumerate(ANSWERS))
    + " END AS response FROM prompts",
    "normalize_responses": f"WITH {NORMAL1} SELECT * FROM first",
    "low_confidence": f"""WITH {NORMAL1}
SELECT request_id, score FROM first WHERE score >= 0.4 AND score <= 0.6""",
    "escalate": f"WITH {NORMAL1}, {NORMAL2}, {ESCALATED} SELECT * FROM escalated",
    "classify": f"WITH {REQUESTS_IN}, {_classified('requests_in')} {CLASSIFY_COLUMNS}",
    "classify_dense": f"WITH {DENSE}, {_classified('requests_dense')} {CLASSIFY_COLUMNS}",
    "decide": f"""WITH {LOG_IN}
SELECT request_id, class, source,
  CASE WHEN class = 'BOT' THEN 'BLOCK' ELSE 'PASS' END AS action,
  CASE WHEN class = 'BOT' THEN 403 ELSE 200 END AS status,
  CASE WHEN class = 'SUSPICIOUS' THEN 'Request flagged as suspicious' END AS warning,
  CASE WHEN class = 'BOT' THEN 'Access denied' END AS error,
  CASE WHEN class = 'BOT' THEN 'Request classified as automated bot traffic.' END AS error_reason,
  {_fixed("score", 2)} AS score_text
FROM log_in""",
    "write_outputs": f"""WITH {REQUESTS_IN}, {_classified('requests_in')}
SELECT ip, count(*) AS logged, count(*) FILTER (source = 'CACHE') AS cached,
  arg_max(class, ts_ms) AS class, arg_max(hits, ts_ms) AS hits, max(ts_ms) AS last_seen,
  count(*) FILTER (source = 'AI') AS fingerprints
FROM classified GROUP BY ip""",
    "classified_by_country": f"""WITH {REQUESTS_IN}, {_classified('requests_in')}
{_by_country(f"(SELECT * FROM classified WHERE ts_ms > {NOW_MS - 24 * 31 * HOUR_MS})")}""",
    "parse_range": f"WITH {LOG_IN} "
    + " UNION ALL ".join(
        f"SELECT '{asked}' AS asked, count(*) AS n FROM log_in WHERE ts_ms > {NOW_MS - hours * HOUR_MS}"
        for asked, hours in (
            ("1h", 1),
            ("6h", 6),
            ("24h", 24),
            ("72h", 72),
            ("0h", 24),
            ("7d", 7),
            ("abc", 24),
            ("-5h", -5),
            ("h12", 12),
            ("", 24),
        )
    ),
    "total": f"WITH {LOGGED} SELECT count(*) AS total FROM ranged",
    "class_breakdown": f"WITH {LOGGED} {CLASS_COUNTS}",
    "source_breakdown": f"WITH {LOGGED} {SOURCE_COUNTS}",
    "top_bot_ips": f"WITH {LOGGED} {TOP_IPS}",
    "by_country": f"WITH {LOGGED} {_by_country('ranged')}",
    "timeline": f"WITH {LOGGED} {TIMELINE}",
    "recent": f"WITH {LOG_IN} {RECENT}",
    "analytics_bundle": f"""WITH {LOGGED}
SELECT 'total' AS section, 'total' AS label, count(*) AS n,
  CAST(NULL AS BIGINT) AS bot, CAST(NULL AS BIGINT) AS legit FROM ranged
UNION ALL SELECT 'breakdown', class, n, NULL, NULL FROM ({CLASS_COUNTS})
UNION ALL SELECT 'source_breakdown', source, n, NULL, NULL FROM ({SOURCE_COUNTS})
UNION ALL SELECT 'top_bot_ips', ip, hits, NULL, NULL FROM ({TOP_IPS})
UNION ALL SELECT 'by_country', country, NULL, bot, legit FROM ({_by_country('ranged')})
UNION ALL SELECT 'timeline', CAST(hour AS VARCHAR), NULL, bot, legit FROM ({TIMELINE})
UNION ALL SELECT 'recent', CAST(request_id AS VARCHAR), ts_ms, NULL, NULL FROM ({RECENT})""",
    "top_bot_share": f"""WITH {LOGGED}
SELECT ip, hits, round(hits::DOUBLE / max(hits) OVER () * 100.0, 6) AS share FROM ({TOP_IPS})""",
    "recent_display": f"""WITH {LOG_IN}
SELECT request_id, ip, country, path, source, class, ts_ms, style,
  CASE WHEN source = 'VECTOR' THEN 'VECTOR' ELSE style END AS badge,
  {_fixed("score * 100", 0)} || '%' AS score_percent
FROM (SELECT *, CASE WHEN class IN ('LEGITIMATE', 'SUSPICIOUS', 'BOT') THEN class
  ELSE 'SUSPICIOUS' END AS style FROM ({RECENT}))""",
    "timeline_labels": f"""WITH {LOGGED}
SELECT CAST(hour AS VARCHAR) || ':00' AS hour, bot AS "Bot", legit AS "Legitimate" FROM ({TIMELINE})""",
    "country_chart": f"""WITH {LOGGED}
SELECT country, bot AS "Bot", legit AS "Legitimate" FROM ({_by_country('ranged')})""",
}

# The search by cells is exact.
ORACLES["fingerprint_cells"] = ORACLES["fingerprint_topk"]
ORACLES["vector_verdict_cells"] = ORACLES["vector_verdict"]
ORACLES["raw_to_decision"] = f"""WITH {REQUESTS_IN},
{RAW.removeprefix(EVENTS + ",")},
classifiable AS (
  SELECT s.* FROM ({SIGNALS}) s JOIN raw_full r USING (request_id)
  WHERE r.method <> 'OPTIONS' AND split_part(r.path, '?', 1) NOT IN ('/analytics', '/health')
),
{_classified("classifiable", TEXT_VECTORS, f"v.query_id = {_signal_text('s.rate')}")}
SELECT request_id, ip, class, source, CASE WHEN class = 'BOT' THEN 'BLOCK' ELSE 'PASS' END AS action,
  CASE WHEN class = 'BOT' THEN 403 ELSE 200 END AS status, {_fixed("score", 2)} AS score_text
FROM classified"""
# A stream must give what the batch gives.
ORACLES["raw_to_decision_stream"] = ORACLES["raw_to_decision"]
ORACLES["stream_sessions"] = f"""WITH {REQUESTS_IN}, {_rated("requests_in")}, {_sessions("rated")}
SELECT request_id, ip, rate, session_start, hits, is_miss FROM sessions"""
ORACLES["stream_classify"] = f"""WITH {REQUESTS_IN}, {_classified("requests_in")}
SELECT request_id, ip, round(score, 6) AS score, class, source FROM classified"""
ORACLES["classify_incremental"] = f"""WITH {DENSE}, {_classified("requests_dense")}
SELECT request_id, ip, round(score, 6) AS score, class, source FROM classified"""
ORACLES["incremental_entries"] = ORACLES["write_outputs"]
# Requests that cannot be tracked neither count nor hold a session open.
ORACLES["classify_dirty"] = f"""WITH {DENSE},
dirty AS (
  SELECT * REPLACE (
    CASE WHEN request_id % 37 <> 0 THEN ip END AS ip,
    CASE WHEN request_id % 41 <> 0 THEN ts_ms END AS ts_ms) FROM requests_dense
),
clean AS (SELECT * FROM dirty WHERE ip IS NOT NULL AND ts_ms IS NOT NULL),
{_classified("clean")}
SELECT request_id, round(score, 6) AS score, class, '' AS errors FROM classified
UNION ALL
SELECT request_id, NULL, NULL, concat_ws(',', CASE WHEN ip IS NULL THEN 'ip' END,
  'score', 'class', 'source', CASE WHEN ts_ms IS NULL THEN 'timestamp' END)
FROM dirty WHERE ip IS NULL OR ts_ms IS NULL"""
ORACLES["stream_analytics"] = ORACLES["analytics_bundle"]
