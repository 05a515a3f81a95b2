"""Secret scans over a trigram index.

Each rule's regex is turned into a Boolean query over the trigrams that any match must
contain. Postings of those trigrams are intersected to candidate documents, and only
candidates are searched with the regex. A rule without mandatory trigrams scans all.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import checkpointed, fresh

with warnings.catch_warnings():
    warnings.simplefilter("ignore")
    import sre_constants as sc
    import sre_parse

#: Up to this many candidates (a hash and the names of a few rules each, under 200 bytes) are sent to every executor.
BROADCAST_ROWS = 500_000


@dataclass(frozen=True)
class Rule:
    """A match counts when its ``group`` has at least ``least`` characters."""

    name: str
    regex: str
    group: int = 0
    least: int = 1


#: The three kinds every scan reports.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: Further kinds, in the formats their issuers publish.
EXTRA = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)
RULES = BASE + EXTRA


def trigram_query(regex: str, most: int = 64) -> list[frozenset[str]]:
    """Alternatives of trigrams, lower-case: any match holds all trigrams of one alternative.

    Empty if some match can do without a trigram. Branches, optional parts and small
    character classes are expanded up to ``most`` forms; anything else is a gap.
    """
    gap = "\0"

    def forms(tree) -> list[str]:  # noqa: ANN001
        out = [""]
        for op, arg in tree:
            if op is sc.LITERAL:
                own = [chr(arg).lower()]
            elif op is sc.SUBPATTERN:
                own = forms(arg[-1])
            elif op is sc.BRANCH:
                own = [f for branch in arg[1] for f in forms(branch)]
            elif op in (sc.MAX_REPEAT, sc.MIN_REPEAT) and arg[:2] == (0, 1):
                own = ["", *forms(arg[2])]
            elif op in (sc.MAX_REPEAT, sc.MIN_REPEAT) and arg[0] > 0:
                own = [f if arg[:2] == (1, 1) else f + gap + f for f in forms(arg[2])]
            elif op is sc.IN and all(o is sc.LITERAL for o, _ in arg):
                own = [chr(c).lower() for _, c in arg]
            elif op is sc.AT:
                own = [""]
            else:
                own = [gap]
            out = [a + b for a in out for b in dict.fromkeys(own)] if len(out) * len(own) <= most else [a + gap for a in out]
        return out

    found = {frozenset(s[i : i + 3] for s in f.split(gap) for i in range(len(s) - 2)) for f in forms(sre_parse.parse(regex))}
    if frozenset() in found:
        return []
    return sorted((f for f in found if not any(g < f for g in found)), key=sorted)


def build_postings(rows: DataFrame, trigrams: list[str], key: str = "key", text: str = "text") -> DataFrame:
    """(trigram, key) for the ``trigrams`` that the lower-cased text holds."""
    low = rows.select(key, F.lower(text).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains(F.col("low"), F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select(key, F.explode(held).alias("trigram")).distinct()


def candidates(postings: DataFrame, rules: tuple[Rule, ...], key: str = "key") -> DataFrame:
    """(key, rules: names of those whose query it meets), by intersecting postings.

    The clause table has a row per rule, alternative and trigram: the rules bound it.
    """
    clauses = [(r.name, i, t, len(a)) for r in rules for i, a in enumerate(trigram_query(r.regex)) for t in sorted(a)]
    table = postings.sparkSession.createDataFrame(clauses, "rule string, alternative int, trigram string, needed int")
    hits = postings.join(F.broadcast(table), "trigram").groupBy(key, "rule", "alternative").agg(F.count(F.lit(1)).alias("n"), F.first("needed").alias("needed"))
    return hits.where("n = needed").groupBy(key).agg(F.collect_set("rule").alias("rules"))


def _bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _walked(items: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column, Column]]) -> Column:
    """Values of type ``kind`` along an array: ``step`` takes a place, first 0, and an item, and gives the next place, whether there is a value, and the value.

    An array that a fold adds to is copied with every item. Items are folded in stretches as
    long as there are stretches, so n of them cost n times the root of n copied pointers, not n squared.
    """

    def inner(acc: Column, x: Column) -> Column:
        at, some, value = step(acc["at"], x)
        return F.struct(at.alias("at"), F.when(some, F.array_append(acc["out"], value)).otherwise(acc["out"]).alias("out"))

    def outer(acc: Column, stretch: Column) -> Column:
        own = F.aggregate(stretch, F.struct(acc["at"].alias("at"), F.array().cast(f"array<{kind}>").alias("out")), inner)
        return _bind(own, lambda r: F.struct(r["at"].alias("at"), F.array_append(acc["out"], r["out"]).alias("out")))

    def stretches(every: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(every))).cast("int")
        return F.when(F.size(every) > 0, F.transform(F.sequence(F.lit(0), F.size(every) - 1, width), lambda i: F.slice(every, i + 1, width))).otherwise(F.array())

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return _bind(items, lambda every: F.flatten(F.aggregate(stretches(every), start, outer, lambda acc: acc["out"])))


SPAN = "struct<start:int,kind:int,end:int>"


def _matches(text: Column, order: int, rule: Rule) -> Column:
    """Spans of a rule: matches lie between the parts that splitting by the regex leaves."""
    gaps = F.transform(F.split(text, rule.regex, -1), lambda s: F.length(s))
    whole = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    tested = whole if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group))
    sizes = F.zip_with(whole, tested, lambda w, t: F.struct(F.length(w).alias("w"), F.length(t).alias("t")))
    each = F.filter(F.zip_with(gaps, sizes, lambda g, s: F.struct(g.alias("g"), s["w"].alias("w"), s["t"].alias("t"))), lambda m: m["w"].isNotNull())

    def step(at: Column, m: Column) -> tuple[Column, Column, Column]:
        begin = at + m["g"]
        end = begin + m["w"]
        return end, m["t"] >= rule.least, F.struct(begin.alias("start"), F.lit(order).alias("kind"), end.alias("end"))

    return _walked(each, SPAN, step)


def _shown(spans: Column, rules: tuple[Rule, ...]) -> Column:
    names = F.array(*[F.lit(r.name) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def find_spans(df: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", out: str = "spans") -> DataFrame:
    """Add the spans of all rules, array<struct<start, kind, end>> by start, kind and end, to every row.

    Spans count code points of the whole text, ends exclusive; ``kind`` is the rule's
    position. Matches are leftmost and do not overlap within a rule. A null text counts
    as empty. Rows meet their candidates by a hash of id and text, so a text that holds
    a third of all rows is not one key; rows alike in both share their candidates. Up to
    BROADCAST_ROWS candidates are sent to every executor; more are joined by a shuffle.
    Rows that repeat are searched each on its own, and no column of ``df`` is touched.
    """
    text, key, named, at = fresh(df, "whole", "key", "rules", "at")
    rows = df.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    rows = rows.withColumn(key, F.xxhash64(*([F.col("doc_id")] if "doc_id" in df.columns else []), F.col(text)))
    queries = {r.name: trigram_query(r.regex) for r in rules}
    needed = sorted({t for q in queries.values() for a in q for t in a})
    if needed:
        found = checkpointed(candidates(build_postings(rows, needed, key, text), rules, key).select(F.col(key).alias(at), F.col("rules").alias(named)))
        few = found.count() <= BROADCAST_ROWS
        rows = rows.join(F.broadcast(found) if few else found, F.col(key) == F.col(at), "left")
    else:
        rows = rows.withColumn(named, F.lit(None).cast("array<string>"))
    none = F.array().cast(f"array<{SPAN}>")
    parts = []
    for i, rule in enumerate(rules):
        # for a single class a run of the least length is the same as a long enough run
        quick = rule.regex[:-1] + f"{{{rule.least},}}" if re.fullmatch(r"\[[^]]+\]\+", rule.regex) else rule.regex
        chosen = F.array_contains(named, rule.name) if queries[rule.name] else F.lit(True)
        parts.append(F.when(chosen & F.col(text).rlike(quick), _matches(F.col(text), i, Rule(rule.name, quick, rule.group, rule.least))).otherwise(none))
    rows = rows.withColumn(out, F.sort_array(F.concat(*parts)))
    return rows.select(*df.columns, out)


def scan_report(df: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of base spans, and all spans, per row."""
    found = find_spans(df.select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    of = lambda i: F.filter("spans", lambda s: s["kind"] == i)
    return found.select(
        "doc_id",
        *[F.size(of(i)).cast("long").alias(f"n_{r.name}") for i, r in enumerate(BASE)],
        F.sha2(_shown(base, RULES), 256).alias("base_sha256"),
        _shown(F.col("spans"), RULES).alias("spans"),
    )


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Replace every span by its kind in brackets; overlapping spans become one, named by the first.

    All rows and columns stay; a null text stays null.
    """
    (spans,) = fresh(df, "spans")
    found = find_spans(df, text_col=text_col, out=spans)
    text = F.coalesce(F.col(text_col), F.lit(""))
    names = F.array(*[F.lit(f"[{r.name}]") for r in RULES])
    # four bytes a code point, so that a stretch is cut out without counting from the start
    wide = F.encode(text, "UTF-32")
    last = F.struct(F.length(text).alias("start"), F.lit(-1).alias("kind"), F.length(text).alias("end"))

    def redacted(raw: Column) -> Column:
        def step(at: Column, s: Column) -> tuple[Column, Column, Column]:
            kept = F.decode(F.substring(raw, at * 4 + 1, (s["start"] - at) * 4), "UTF-32")
            return F.greatest(at, s["end"]), s["start"] >= at, F.concat(kept, F.when(s["kind"] >= 0, F.get(names, s["kind"])).otherwise(F.lit("")))

        return F.array_join(_walked(F.array_append(F.col(spans), last), "string", step), "")

    clean = _bind(wide, redacted)
    return found.withColumn(text_col, F.when(F.size(spans) == 0, F.col(text_col)).otherwise(clean)).drop(spans)


def _oracle() -> str:
    parts = []
    for i, r in enumerate(RULES):
        regex = r.regex.replace("'", "''")
        parts.append(f"""SELECT rid, {i} AS kind, '{r.name}' AS name, list_sum(list_transform(gaps[1:j], lambda x: LENGTH(x))) + COALESCE(list_sum(list_transform(hits[1:j-1], lambda x: LENGTH(x))), 0) AS s, LENGTH(hits[j]) AS len, LENGTH(tested[j]) AS t, {r.least} AS least
  FROM (SELECT *, UNNEST(range(1, len(hits) + 1)) AS j FROM (SELECT rid, string_split_regex(text, '{regex}') AS gaps, regexp_extract_all(text, '{regex}', 0) AS hits, regexp_extract_all(text, '{regex}', {r.group}) AS tested FROM d WHERE regexp_matches(text, '{regex}')))""")
    return f"""
WITH d AS (SELECT ROW_NUMBER() OVER () AS rid, doc_id, COALESCE(text, '') AS text FROM documents),
m AS ({' UNION ALL '.join(parts)}),
s AS (SELECT rid, kind, s, name || ':' || s::BIGINT || ':' || (s + len)::BIGINT AS shown FROM m WHERE t >= least),
g AS (SELECT rid, COUNT(*) FILTER (WHERE kind = 0) AS n_assign, COUNT(*) FILTER (WHERE kind = 1) AS n_access, COUNT(*) FILTER (WHERE kind = 2) AS n_hex,
        COALESCE(STRING_AGG(shown, ',' ORDER BY s, kind) FILTER (WHERE kind < 3), '') AS base, STRING_AGG(shown, ',' ORDER BY s, kind) AS spans FROM s GROUP BY rid)
SELECT d.doc_id, COALESCE(n_assign, 0) AS n_assign, COALESCE(n_access, 0) AS n_access, COALESCE(n_hex, 0) AS n_hex,
       sha256(COALESCE(base, '')) AS base_sha256, COALESCE(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)
"""


ORACLE = _oracle()
