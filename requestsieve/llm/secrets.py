"""Secret scans over a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams that every match
must contain: any of several sets, each of which must be there whole. The index lists the
documents of each such trigram; intersecting its postings gives the candidates of a rule, and
only they are searched with the expression. A rule without mandatory trigrams searches every
document. The index is in lower case, so it serves rules in either case; the search decides.
"""

import re
from dataclasses import dataclass
from re import _constants as op
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from requestsieve.llm.common import ROW_KEY, row_key, whole_text, written

# Alternatives of a pattern beyond this are cut into shorter literal runs.
MOST_ALTERNATIVES = 64


@dataclass(frozen=True)
class Rule:
    """`pattern` is read alike by Java and Python. Matches whose `group` has under `at_least`
    characters are found, so that later ones may not overlap them, and then dropped."""

    kind: str
    pattern: str
    group: int = 0
    at_least: int = 0


# A run of letters of one class is matched whole, so its least length may stand in the pattern.
BASE = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
        r"""([A-Za-z0-9+/_.=-]+)""",
        group=2,
        at_least=6,
    ),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
# Well-known token formats that the base rules do not cover.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)
RULES = BASE + MORE

# A literal run that may be extended at its end is open; a break closes it.
Runs = tuple[str, ...]


def _join(left: set[Runs], right: set[Runs]) -> set[Runs]:
    """Every left alternative followed by every right one; runs meet where both are open."""
    if len(left) * len(right) > MOST_ALTERNATIVES:
        if _longest(left) < _longest(right):
            left = {("", "")}
        else:
            right = {("", "")}
    return {(*a[:-1], a[-1] + b[0], *b[1:]) for a in left for b in right}


def _longest(runs: set[Runs]) -> int:
    """Length of a literal run that any alternative has at least."""
    return min(max(map(len, alternative)) for alternative in runs)


def _runs(tree) -> set[Runs]:
    """Alternatives of literal runs in order; an empty run at an end means anything goes there."""
    found: set[Runs] = {("",)}
    anything = {("", "")}
    for kind, value in tree:
        if kind is op.LITERAL:
            part = {(chr(value).lower(),)}
        elif kind is op.IN and all(k is op.LITERAL for k, _ in value):
            part = {(chr(c).lower(),) for _, c in value}
        elif kind is op.SUBPATTERN:
            part = _runs(value[-1])
        elif kind is op.BRANCH:
            part = set().union(*(_runs(branch) for branch in value[1]))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            low, high, inner = value
            own = _runs(inner)
            if low == high == 1:
                part = own
            elif (low, high) == (0, 1):
                part = own | {("",)}
            elif low:
                part = own
                for _ in range(min(low, 3) - 1):
                    part = _join(part, own)
                part = part if low == high <= 3 else _join(part, anything)
            else:
                part = anything
        elif kind is op.AT:
            part = {("",)}
        else:
            part = anything
        found = _join(found, part)
    return found


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Sets of trigrams, one of which every match contains whole; none if a match may lack any."""
    sets = {
        frozenset(run[i : i + 3] for run in runs for i in range(len(run) - 2))
        for runs in _runs(parser.parse(pattern))
    }
    if frozenset() in sets:
        return []
    least = {s for s in sets if not any(other < s for other in sets)}
    return sorted(least, key=sorted)


def build_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, __rs_id, __rs_row) of the given trigrams, stored by trigram.

    Each text is looked through once per trigram by a plain substring search. Rows are dealt by
    trigram before the write, and a frequent trigram is many tasks.
    """
    lower = F.lower(whole_text())
    present = F.array_compact(
        F.array(*[F.when(F.contains(F.col("__rs_lower"), F.lit(t)), F.lit(t)) for t in trigrams])
    )
    postings = (
        docs.withColumn("__rs_lower", lower)
        .select("__rs_id", "__rs_row", F.explode(present).alias("trigram"))
        .hint("rebalance", "trigram")
    )
    return written(postings, "postings")


def candidates(postings: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """(__rs_id, __rs_row, kinds) of documents whose trigrams meet a rule's query.

    Postings are gathered per document, where there are never more than the index has trigrams,
    and each set of a query must be among them.
    """
    found = F.collect_set("trigram").alias("trigrams")

    def meets(sets: list[frozenset[str]]) -> Column:
        either = F.lit(False)
        for needed in sets:
            every = F.array(*[F.lit(t) for t in sorted(needed)])
            either = either | (F.size(F.array_except(every, F.col("trigrams"))) == 0)
        return either

    used = sorted({t for sets in queries.values() for s in sets for t in s})
    kinds = F.array_compact(
        F.array(*[F.when(meets(sets), F.lit(kind)) for kind, sets in queries.items()])
    )
    return (
        postings.filter(F.col("trigram").isin(used))
        .groupBy("__rs_id", "__rs_row")
        .agg(found)
        .select("__rs_id", "__rs_row", kinds.alias("__rs_kinds"))
        .filter(F.size("__rs_kinds") > 0)
    )


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """Spans of the leftmost non-overlapping matches, ends excluded, in code points.

    The text is split at its matches; the lengths of the parts and of the matches before one
    give its place.
    """
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    checked = matches if not rule.group else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    parts = F.zip_with(
        F.split(text, rule.pattern, -1),
        F.arrays_zip(matches.alias("m"), checked.alias("c")),
        lambda gap, x: F.struct(
            F.length(gap).alias("gap"),
            F.length(x["m"]).alias("length"),
            F.length(x["c"]).alias("checked"),
        ),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))

    def step(state: Column, p: Column) -> Column:
        begin = state["at"] + p["gap"]
        end = begin + F.coalesce(p["length"], F.lit(0))
        span = F.struct(
            begin.alias("start"),
            F.lit(order).alias("order"),
            end.alias("end"),
            F.lit(rule.kind).alias("kind"),
        )
        keep = F.coalesce(p["checked"] >= rule.at_least, F.lit(False))
        return F.struct(
            end.alias("at"),
            F.when(keep, F.concat(state["spans"], F.array(span)))
            .otherwise(state["spans"])
            .alias("spans"),
        )

    return F.aggregate(parts, start, step, lambda state: state["spans"])


SPANS = "array<struct<start:int,order:int,end:int,kind:string>>"


def as_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    return F.array_join(F.transform(spans, one), ",")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, __rs_spans): the spans of every rule in every row, by start, then rule order.

    Null and empty texts have no spans; repeated rows each get theirs; a null doc_id is a row
    like any other. Rows meet their candidate rules in one join by row key; a rule's expression
    is evaluated only in its candidates.
    """
    rows = docs.select("doc_id", "text", *row_key())
    queries = {rule.kind: trigram_query(rule.pattern) for rule in rules}
    indexed = {kind: sets for kind, sets in queries.items() if sets}
    trigrams = sorted({t for sets in indexed.values() for s in sets for t in s})
    found = rows.withColumn("__rs_kinds", F.array().cast("array<string>"))
    if trigrams:
        chosen = candidates(build_index(rows, trigrams), indexed)
        found = rows.join(chosen, ROW_KEY, "left")
    none = F.array().cast(SPANS)
    parts = []
    for order, rule in enumerate(rules):
        due = F.lit(True)
        if rule.kind in indexed:
            due = F.coalesce(F.array_contains("__rs_kinds", rule.kind), F.lit(False))
        due = due & F.col("__rs_text").rlike(rule.pattern)
        parts.append(F.when(due, spans_of(F.col("__rs_text"), rule, order)).otherwise(none))
    return found.withColumn("__rs_text", whole_text()).select(
        "doc_id", F.array_sort(F.concat(*parts)).alias("__rs_spans")
    )
