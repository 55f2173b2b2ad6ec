"""Quality rules by weak supervision, in DataFrame functions only.

Each rule looks at statistics of one text and votes good (1), bad (0) or
abstains.  Expectation-maximisation over the counts of vote patterns (at most
3**rules rows, however large the corpus) estimates how often every rule votes on good
and on bad documents and the share of good ones; a document is kept if its posterior probability of
being good is at least ``KEEP_FROM``.  No label is read.

Words are runs of anything but x20 and x09-x0D.  Defined cases: a null or empty
text has no words, fails the base rules and is not kept; very long texts are
worked on whole, one row at a time; repeated rows are judged row by row; an
empty table gives no rows; other columns are not read.  Repeated three-word
windows are found by sorting 64-bit hashes of a text's windows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut

KEEP_FROM = 0.5
ROUNDS = 200
#: EM starts from this share of good documents, and from a rule's bad votes on bad and good documents and its good votes on them.
START_GOOD, START_RATES = 0.85, ((0.4, 0.02), (0.3, 0.6))
#: The starting rates count as so many documents of each class in every round.
PRIOR = 1.0
SPACE = r"[\\x20\\x09-\\x0D]+"

#: name -> (votes bad where, votes good where); neither: it abstains. Shares are of words, characters or lines.
RULES: dict[str, tuple[str, str]] = {
    "length": ("n_words < 50", "n_words >= 100 and n_words <= 100000"),
    "symbols": ("n_symbols > 0.10 * n_words", "false"),
    "symbol_runs": ("n_symbol_runs > 0.05 * n_words", "false"),
    "repeated_windows": ("n_repeat_words > 0.30 * n_words", "false"),
    "duplicate_lines": ("n_dup_lines > 0.50 * n_lines", "false"),
    "word_length": ("word_chars < 2 * n_words or word_chars > 12 * n_words", "false"),
    "shouting": ("n_upper > 0.40 * word_chars", "false"),
    "exclaims": ("n_marks > 0.20 * n_words", "false"),
    "prose": ("false", "n_symbols <= 0.01 * n_words and n_upper <= 0.10 * word_chars and n_marks <= 0.02 * n_words and n_repeat_words <= 0.10 * n_words"),
}


def _words() -> Column:
    return F.expr(f"array_remove(split(coalesce(text, ''), '{SPACE}'), '')")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts the rules need, one row per row of docs; every expression stays in the JVM."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("doc_id", "text", _words().alias("w"), F.expr("filter(split(text, '\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')").alias("lines"))
    d = d.select(
        "doc_id",
        "w",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.expr("regexp_count(text, '[#*$%&|<>]')").cast("long").alias("n_symbols"),
        F.expr("regexp_count(text, '[#*$%&|<>]+')").cast("long").alias("n_symbol_runs"),
        F.expr("regexp_count(text, '[A-Z]')").cast("long").alias("n_upper"),
        F.expr("regexp_count(text, '!')").cast("long").alias("n_marks"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    # a long of the window's hash without its low bits, which hold the place; sorted, equal windows are neighbours in text order
    d = d.withColumn("bits", F.expr("cast(ceil(log2(greatest(n_words, 2) + 1)) as int)"))
    d = d.withColumn("h", F.expr("case when n_words < 3 then array() else transform(sequence(0, cast(n_words as int) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])) end"))
    d = d.drop("w").withColumn("n_distinct", F.size(F.array_distinct("h")))
    d = d.withColumn("k", F.expr("case when n_distinct = size(h) then cast(array() as array<bigint>) else sort_array(transform(h, (x, i) -> shiftleft(shiftrightunsigned(x, bits), bits) | i)) end"))
    same = "shiftrightunsigned(k[{0}], bits) = shiftrightunsigned(k[{1}], bits) and h[cast(k[{0}] & m as int)] = h[cast(k[{1}] & m as int)]"
    d = d.withColumn("m", F.expr("shiftleft(1L, bits) - 1"))
    d = d.withColumn("p", F.expr(f"sort_array(transform(filter(k, (x, i) -> (i > 0 and {same.format('i', 'i - 1')}) or (i + 1 < size(k) and {same.format('i', 'i + 1')})), x -> x & m))"))
    d = d.withColumn("n_repeat_words", F.expr("aggregate(transform(p, (x, i) -> case when i + 1 < size(p) then least(3L, p[i + 1] - x) else 3L end), 0L, (a, x) -> a + x)"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_symbol_runs", "n_upper", "n_marks")


#: Rules that vote on texts without words as well.
ON_EMPTY = frozenset({"length"})


def vote(bad: str, good: str, on_empty: bool = False) -> Column:
    """1 good, 0 bad, -1 abstains, as it does on a text without words unless on_empty."""
    return F.expr(f"case when n_words = 0 and not {str(on_empty).lower()} then -1 when {bad} then 0 when {good} then 1 else -1 end")


Rates = tuple[tuple[float, float], tuple[float, float]]


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, list[Rates]]:
    """(share of good documents, per rule its rates) by EM over (votes, documents).

    Rates are ((bad votes on bad, on good), (good votes on bad, on good)), each
    per document of that class.  Rules vote independently given the class, and
    abstaining says nothing.  A bad vote is never taken as rarer on bad documents
    than on good ones, nor a good vote as rarer on good ones, so no rule is turned
    round.  Sums run in a fixed order, so equal counts give equal numbers.
    Without documents the starting values come back.
    """
    patterns = sorted(patterns)
    rules = len(patterns[0][0]) if patterns else len(RULES)
    share, rates = START_GOOD, [START_RATES] * rules
    total = float(sum(n for _, n in patterns))
    for _ in range(rounds if total else 0):
        good = 0.0
        seen = [[[PRIOR * x for x in START_RATES[v]] for v in (0, 1)] for _ in range(rules)]
        for votes, n in patterns:
            p = posterior(votes, share, rates)
            good += n * p
            for s, v in zip(seen, votes):
                if v >= 0:
                    s[v][0] += n * (1 - p)
                    s[v][1] += n * p
        share = min(0.999, max(0.001, good / total))
        rates = []
        for s in seen:
            (b0, g0), (b1, g1) = ((x[0] / (total - good + PRIOR), x[1] / (good + PRIOR)) for x in s)
            rates.append(((max(b0, g0), g0), (min(b1, g1), g1)))
    return share, rates


def weights(rates: Rates) -> tuple[float, float]:
    """Log odds of good that a bad and a good vote of a rule add."""
    return tuple(math.log(max(g, 1e-6) / max(b, 1e-6)) for b, g in rates)


def posterior(votes: tuple[int, ...], share: float, rates: list[Rates]) -> float:
    z = math.log(share / (1 - share)) + sum(weights(r)[v] for v, r in zip(votes, rates) if v >= 0)
    return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def quality_rules(docs: DataFrame, rules: dict[str, tuple[str, str]] = RULES, keep_from: float = KEEP_FROM, on_empty: frozenset[str] = ON_EMPTY) -> DataFrame:
    """Statistics, the posterior probability of good, base_failed and kept for each row of docs."""
    names = list(rules)
    # the texts are read once: what is counted here serves both the fit and the verdicts
    stats = cut(statistics(docs).withColumns({f"v_{k}": vote(*rules[k], k in on_empty) for k in names}), "quality-rules")
    patterns = [(tuple(r[:-1]), r[-1]) for r in stats.groupBy(*[f"v_{k}" for k in names]).count().collect()]  # 3**rules rows at most
    share, rates = fit(patterns)
    z = F.lit(math.log(share / (1 - share)))
    for k, a in zip(names, rates):
        bad, good = weights(a)
        z = z + F.when(F.col(f"v_{k}") == 1, good).when(F.col(f"v_{k}") == 0, bad).otherwise(0.0)
    out = stats.withColumn("quality", 1 / (1 + F.exp(-z)))
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("quality") >= keep_from))
