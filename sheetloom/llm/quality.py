"""Quality rules with risk-controlled cutoffs.

Each rule rejects documents past a cutoff of one measure. Cutoffs are chosen per
stratum on labelled documents so that, with the stated confidence over all strata and
rules together, no rule rejects more than its share of good documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._util import checkpointed, fresh

WHITE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: measure -> cutoffs from mild to strict; a document is rejected when the measure is above the cutoff.
RULES = {
    "symbols": [2.0, 1.5, 1.0, 0.7, 0.5, 0.35, 0.25, 0.15, 0.1],
    "repeats": [0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1],
    "dup_lines": [0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1],
    "long_words": [30.0, 20.0, 16.0, 13.0, 11.0, 10.0],
    "short_words": [-1.5, -2.0, -2.5, -3.0, -3.5],
}


def base_measures(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (lines with a word) of the whole text.

    A null text has none of anything. Repeated 3-word windows are found by sorting the
    64-bit hashes of a text's windows with their positions; a text whose windows all
    differ is not sorted.
    """
    words, lines, grams, ordered, starts = fresh(df, "words", "lines", "grams", "sorted", "starts")
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = df.withColumns(
        {
            words: F.filter(F.split(text, WHITE), lambda w: w != ""),
            lines: F.filter(F.split(text, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")),
            "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        }
    )
    df = df.withColumn(
        grams,
        F.when(F.size(words) < 3, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.slice(words, 1, F.size(words) - 2), lambda w, i: F.xxhash64(w, F.get(F.col(words), i + 1), F.get(F.col(words), i + 2)))
        ),
    )
    df = df.withColumn(
        ordered,
        F.when(F.size(F.array_distinct(grams)) < F.size(grams), F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))),
    )
    same = lambda x, i: x["g"].eqNullSafe(F.get(F.col(ordered), i)["g"])
    df = df.withColumn(starts, F.sort_array(F.transform(F.filter(ordered, lambda x, i: same(x, i + 1) | same(x, i - 1)), lambda x: x["i"])))
    # a start covers its three words, or those up to the next start
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("till")),
        lambda acc, i: F.struct((acc["n"] + i + 3 - F.greatest(acc["till"], i)).alias("n"), (i + 3).alias("till")),
        lambda acc: acc["n"],
    )
    df = df.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "n_lines": F.size(lines).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        }
    )
    return df.drop(words, lines, grams, ordered, starts)


def measures() -> dict[str, Column]:
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "symbols": F.col("n_symbols") / words,
        "repeats": F.col("n_repeat_words") / words,
        "dup_lines": F.col("n_dup_lines") / lines,
        "long_words": F.col("word_chars") / words,
        "short_words": -F.col("word_chars") / words,
    }


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(at most k of n) when each has probability p, summed in logarithms."""
    import math

    odds, first = math.log(p / (1 - p)), n * math.log1p(-p)
    start = F.struct(first.cast("double").alias("term"), first.cast("double").alias("total"))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + odds
        top = F.greatest(term, acc["total"])
        return F.struct(term.alias("term"), (top + F.log(F.exp(term - top) + F.exp(acc["total"] - top))).alias("total"))

    many = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.least(F.lit(1.0), F.aggregate(many, start, add, lambda acc: F.exp(acc["total"])))


def choose_cutoffs(holdout: DataFrame, stratum: str = "stratum", risk: float = 0.02, error: float = 0.05) -> DataFrame:
    """(stratum, rule, cutoff) for the rules that may be used; ``holdout`` has the measures of good documents.

    For each cutoff, from mild to strict, the exact binomial test asks whether the share
    of good documents it rejects could still exceed ``risk`` over the number of rules;
    the first cutoff that fails ends its sequence, so one sequence needs no correction
    for its length, and ``error`` is divided by the number of sequences (strata times
    rules). A stratum with too few labels keeps no cutoff.
    """
    share = risk / len(RULES)
    counts = [F.count(F.lit(1)).alias("n")] + [F.count_if(m > cut).alias(f"{rule}{i}") for rule, m in measures().items() for i, cut in enumerate(RULES[rule])]
    table = holdout.groupBy(F.col(stratum).alias("stratum")).agg(*counts)
    tests = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("i"), F.lit(float(cut)).alias("cutoff"), F.col(f"{rule}{i}").alias("k")) for rule, cuts in RULES.items() for i, cut in enumerate(cuts)])
    table = table.select("stratum", "n", F.inline(tests))
    table = table.withColumn("sequences", F.size(F.collect_set(F.struct("stratum")).over(Window.partitionBy(F.lit(1)))) * len(RULES))
    table = table.withColumn("failed", binomial_tail(F.col("k"), F.col("n"), share) > error / F.col("sequences"))
    ahead = Window.partitionBy("stratum", "rule").orderBy("i")
    return table.withColumn("ended", F.max("failed").over(ahead)).where(~F.col("ended")).groupBy("stratum", "rule").agg(F.min_by("cutoff", -F.col("i")).alias("cutoff"))


def risk_controlled(df: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.02, error: float = 0.05) -> DataFrame:
    """Base measures of every document, base_failed, and kept after the chosen cutoffs.

    ``labels`` (doc_id, quality) marks good documents with 1; a document labelled more
    than once counts once, as good if any label says so. Null strata are one stratum.
    Documents of a stratum without cutoffs are judged by the base rule alone. Extra
    columns of ``df`` are left out.
    """
    # read by the cutoffs and by the verdicts: a few numbers a document, so that texts are measured once
    rows = checkpointed(base_measures(df.select("doc_id", "text", F.col(stratum).alias("stratum"))).drop("text"))
    good = labels.groupBy("doc_id").agg(F.max("quality").alias("_q")).where("_q = 1").select(F.col("doc_id").alias("_id"))
    # the distinct strata and rules bound this table, not the documents
    cutoffs = choose_cutoffs(rows.join(good, F.col("doc_id") == F.col("_id"), "left_semi"), risk=risk, error=error)
    wide = cutoffs.groupBy(F.col("stratum").alias("_stratum")).agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_{r}") for r in RULES])
    rows = rows.join(wide, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rejected = reduce(lambda a, b: a | b, [F.coalesce(m > F.col(f"_{r}"), F.lit(False)) for r, m in measures().items()])
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~rejected).alias("kept")
    )


def _oracle() -> str:
    ws = r"'[\x20\x09-\x0D]+'"
    ratio = {"symbols": "n_symbols / GREATEST(n_words, 1)", "repeats": "n_repeat_words / GREATEST(n_words, 1)", "dup_lines": "n_dup_lines / GREATEST(n_lines, 1)", "long_words": "word_chars / GREATEST(n_words, 1)", "short_words": "-word_chars / GREATEST(n_words, 1)"}
    grid = ", ".join(f"('{r}', {i}, {c}::DOUBLE)" for r, cuts in RULES.items() for i, c in enumerate(cuts))
    pick = " ".join(f"WHEN '{r}' THEN {m}" for r, m in ratio.items())
    p = 0.02 / len(RULES)
    return f"""
WITH d AS (SELECT ROW_NUMBER() OVER () AS rid, doc_id, lang, COALESCE(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, lang, text, list_filter(string_split_regex(text, {ws}), lambda x: x <> '') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS t FROM (SELECT rid, ws, UNNEST(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
h AS (SELECT rid, i FROM (SELECT rid, i, COUNT(*) OVER (PARTITION BY rid, t) AS n FROM g) WHERE n > 1),
c AS (SELECT rid, COUNT(DISTINCT i + k) AS n FROM h, (SELECT UNNEST([0, 1, 2]) AS k) GROUP BY rid),
b AS (SELECT w.doc_id, w.lang, len(ws)::BIGINT AS n_words, len(ls)::BIGINT AS n_lines,
        LENGTH(regexp_replace(text, {ws}, '', 'g'))::BIGINT AS word_chars,
        (LENGTH(text) - LENGTH(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, COALESCE(c.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN c USING (rid)),
good AS (SELECT * FROM b WHERE doc_id IN (SELECT doc_id FROM labels GROUP BY 1 HAVING MAX(quality) = 1)),
t AS (SELECT lang, rule, i, cut, COUNT(*) AS n, COUNT(*) FILTER (WHERE CASE rule {pick} END > cut) AS k
      FROM good, (VALUES {grid}) v(rule, i, cut) GROUP BY ALL),
q AS (SELECT lang, rule, i, cut, (SELECT SUM(EXP(LGAMMA(t.n + 1) - LGAMMA(j + 1) - LGAMMA(t.n - j + 1) + j * LN({p}) + (t.n - j) * LN(1 - {p})))
        FROM (SELECT UNNEST(range(0, t.k + 1)) AS j)) > 0.05 / ((SELECT COUNT(*) FROM (SELECT DISTINCT lang FROM good)) * {len(RULES)}) AS failed FROM t),
e AS (SELECT *, MAX(failed::INT) OVER (PARTITION BY lang, rule ORDER BY i) AS ended FROM q),
cut AS (SELECT lang, rule, ARG_MAX(cut, i) AS cut FROM e WHERE ended = 0 GROUP BY ALL),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT EXISTS (SELECT 1 FROM cut WHERE cut.lang IS NOT DISTINCT FROM f.lang AND CASE rule {pick} END > cut.cut) AS kept
FROM f
"""


ORACLE = _oracle()
