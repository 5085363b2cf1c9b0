"""Operator 8: quality rules by weak supervision, with DataFrame functions alone.

Rules vote against a document (0), abstain (1) or vote for it (2).  How often each
pattern of votes occurs is counted over all documents of ``LEAST`` words or more (at
most 3 ** len(RULES) patterns, so the table that reaches the driver is bounded), and
expectation-maximisation estimates the share of good documents and how each rule
votes on good and on bad ones.  A document is kept if it passes the base and its
posterior probability of being good is at least ``KEEP``.

Two classes and one table of votes for each rule are estimated, under two
constraints that keep the classes from trading places or splitting the good one: a
vote against is never likelier on good documents than on bad ones, and a vote for
never likelier on bad ones; where the counts say otherwise, the rule has one table
for both and so no weight.  Rules don't repeat the base's two conditions.

Words are ``[^\\x20\\x09-\\x0D]+``.  Repeated 3-word windows are found inside the
row: window hashes, their low bits replaced by the position, are sorted as longs;
equal neighbours are compared word by word.  Should neighbours differ, the row's
windows are sorted by their words instead, so counts are exact.

Very long texts: one row holds its words and 8 bytes for each; there is no limit
but a row's 2 GB.

Defined cases: null and empty texts have no words, fail the base and aren't kept.
The operator is row by row but for the pattern counts, so ids may be null or
repeat.  Extra columns stay; those named like an output are replaced (by
``quality_filter`` none is).  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._frames import documents, extras, written

KEEP = 0.5
ROUNDS = 60
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MORE = ("n_lines", "n_letters", "n_capitals", "n_marks", "n_plain", "n_ends")
_TAKEN = (*STATS, *_MORE, "base_failed", "kept", "p_good", "pattern")
LEAST = 50
_BASE = f"(n_words < {LEAST} or 100 * n_repeat_words > 50 * n_words)"
#: A word of letters and digits, with quotes or brackets before and usual marks after.
_PLAIN = r"""^["'(\[«„“‚‘¿¡]*[\p{L}\p{N}][\p{L}\p{M}\p{N}'’-]*[.,;:!?…"')\]»”’]*$"""
_END = r"""[.!?…。！？]["')\]»”’]*$"""


def _vote(bad: str, good: str) -> str:
    return f"(case when {bad} then 0 when {good} then 2 else 1 end)"


#: Thresholds for symbols, word length and repeated lines follow published heuristic filters; the others are this module's own.
RULES = {
    "symbols": _vote("n_symbols > 0.1 * n_words", "n_symbols <= 0.02 * n_words"),
    "plain": _vote("n_plain < 0.6 * n_words", "n_plain >= 0.8 * n_words"),
    "lines": _vote("n_dup_lines > 0.3 * n_lines", "n_dup_lines <= 0.05 * n_lines"),
    "word_size": _vote("word_chars < 3 * n_words or word_chars > 10 * n_words", "word_chars between 3.5 * n_words and 9 * n_words"),
    "shouting": _vote("n_capitals > 0.4 * n_letters", "n_capitals <= 0.15 * n_letters"),
    "marks": _vote("n_marks > 0.3 * n_words", "n_marks <= 0.1 * n_words"),
    "sentences": _vote("n_ends > 0.5 * n_words", "n_ends between 0.02 * n_words and 0.34 * n_words"),
}


def _let(value: Column, use) -> Column:
    """use(value), evaluating value once."""
    return F.transform(F.array(value), use)[0]


def _window_hash(a: Column, b: Column, c: Column) -> Column:
    return F.xxhash64(a, b, c)


def _covered(starts: Column) -> Column:
    return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))


def repeat_words(words: Column, hashed: Callable[[Column, Column, Column], Column] = _window_hash) -> Column:
    """How many words lie in 3-word windows that are found twice or more. hashed: the hash of a window's words."""

    def of(w: Column) -> Column:
        n = F.size(w)
        starts = F.sequence(F.lit(0), n - 3)

        def same_words(i: Column, j: Column) -> Column:
            return (F.get(w, i) == F.get(w, j)) & (F.get(w, i + 1) == F.get(w, j + 1)) & (F.get(w, i + 2) == F.get(w, j + 2))

        def exact() -> Column:
            def twice(k: Column) -> Column:
                def same(x: Column, j: Column) -> Column:
                    other = F.get(k, j)
                    return F.coalesce((x["a"] == other["a"]) & (x["b"] == other["b"]) & (x["c"] == other["c"]), F.lit(False))

                return _covered(F.transform(F.filter(k, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))

            windows = F.transform(starts, lambda i: F.struct(F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.alias("i")))
            return _let(F.sort_array(windows), twice)

        def packed(mask: Column) -> Column:
            top = F.bitwise_not(mask)
            hashes = F.transform(starts, lambda i: hashed(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(top).bitwiseOR(i.cast("long")))

            def place(x: Column) -> Column:
                return x.bitwiseAND(mask).cast("int")

            def twice(k: Column) -> Column:
                def same(x: Column, j: Column) -> Column:
                    return F.coalesce(x.bitwiseXOR(F.get(k, j)).bitwiseAND(top) == 0, F.lit(False))

                odd = F.filter(k, lambda x, j: F.when(same(x, j - 1), ~same_words(place(x), place(F.get(k, j - 1)))).otherwise(F.lit(False)))
                found = F.filter(k, lambda x, j: same(x, j - 1) | same(x, j + 1))
                return F.when(F.size(odd) > 0, exact()).otherwise(_covered(F.transform(found, place)))

            return _let(F.sort_array(hashes), twice)

        mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(n))) - 1
        return F.when(n < 4, F.lit(0)).otherwise(_let(mask, packed))

    return _let(words, of)


def statistics(docs: DataFrame, repeats: bool = True) -> DataFrame:
    """docs with the five base statistics and those that the rules also need; repeats: with n_repeat_words, which no rule needs."""
    docs = docs.select(*extras(docs, *_TAKEN))
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            *([repeat_words(w).cast("long").alias("n_repeat_words")] if repeats else []),
            F.size(F.filter(w, lambda x: x.rlike(_PLAIN))).cast("long").alias("n_plain"),
            F.size(F.filter(w, lambda x: x.rlike(_END))).cast("long").alias("n_ends"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    def only(pattern: str) -> Column:
        return F.length(F.regexp_replace(text, f"[^{pattern}]+", "")).cast("long")

    kinds = {"n_symbols": only("#*$%&|<>"), "n_letters": only(r"\p{L}"), "n_capitals": only(r"\p{Lu}"), "n_marks": only("!?")}
    w, x = "__w", "__l"
    while {w, x} & {c.lower() for c in docs.columns}:
        w, x = f"_{w}", f"_{x}"
    out = docs.withColumns({w: _let(words, of_words), x: _let(lines, of_lines), **kinds})
    return out.select(*docs.columns, f"{w}.*", f"{x}.*", *kinds)


def pattern() -> Column:
    """The votes of all rules as one number in base 3."""
    code = "0"
    for rule in RULES.values():
        code = f"({code}) * 3 + {rule}"
    return F.expr(f"int({code})")


#: Pseudo-counts: votes (against, abstain, for) of a rule on good and on bad documents, and of the two classes.
_VOTES_GOOD, _VOTES_BAD = (0.1, 0.9, 3.0), (1.0, 1.0, 2.0)
_CLASSES = (3.0, 1.0)


def fit(counts: dict[int, int], rules: int, rounds: int = ROUNDS) -> tuple[dict[int, float], float, list[tuple[list[float], list[float]]]]:
    """(posterior of being good for each pattern, share of good documents, for each rule its votes on good and on bad).

    Expectation-maximisation over all counts, from the view that a vote against is mostly right."""
    votes = {c: [c // 3 ** (rules - 1 - j) % 3 for j in range(rules)] for c in sorted(counts)}
    good = {c: 0.05 if 0 in v else 0.95 for c, v in votes.items()}
    total = sum(counts.values())
    share, tables = 0.0, []
    for _ in range(rounds):
        share = (sum(counts[c] * p for c, p in good.items()) + _CLASSES[0]) / (total + sum(_CLASSES))
        tables = []
        for j in range(rules):
            g, b = list(_VOTES_GOOD), list(_VOTES_BAD)
            for c, v in votes.items():
                g[v[j]] += counts[c] * good[c]
                b[v[j]] += counts[c] * (1 - good[c])
            both = [(x + y) / (sum(g) + sum(b)) for x, y in zip(g, b)]
            g, b = [x / sum(g) for x in g], [x / sum(b) for x in b]
            tables.append((g, b) if g[0] <= b[0] and g[2] >= b[2] else (both, both))
        for c, v in votes.items():
            odds = math.log(share / (1 - share)) + sum(math.log(g[x] / b[x]) for x, (g, b) in zip(v, tables))
            good[c] = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
    return good, share, tables


def judge(stats: DataFrame, counted: DataFrame) -> DataFrame:
    """stats with base_failed, p_good and kept; votes are counted over ``counted``, which has all documents' statistics."""
    spark = stats.sparkSession
    found = counted.groupBy(pattern().alias("pattern")).agg(F.count_if(F.col("n_words") >= LEAST).alias("n")).collect()  # at most 3 ** len(RULES)
    good, _, _ = fit({r["pattern"]: r["n"] for r in found}, len(RULES))
    rows = ", ".join(f"({c}, {p!r}D)" for c, p in (good or {0: 0.0}).items())
    table = spark.sql(f"select int(c) as pattern, double(p) as p_good from values {rows} as t(c, p)")
    out = stats.withColumn("pattern", pattern()).join(F.broadcast(table), "pattern").drop("pattern")
    out = out.withColumn("base_failed", F.expr(_BASE))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= KEEP))


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with the columns of docs.

    Texts are read twice, the first time for the rules' votes alone: nothing is written in between."""
    names = docs.columns
    low = {x.lower() for x in _TAKEN}
    clash = [c for c in names if c.lower() in low]
    carried = docs.withColumnsRenamed({c: f"__in_{c}" for c in clash})
    out = judge(statistics(carried), statistics(docs.select("text"), repeats=False)).filter("kept")
    return out.select(*(F.col(f"__in_{c}").alias(c) if c in clash else F.col(c) for c in names))


def quality_rules(docs: DataFrame) -> DataFrame:
    """docs without text, with the statistics, base_failed, p_good and kept."""
    stats = written(statistics(docs).drop("text"), "quality")
    return judge(stats, stats)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", *STATS, "base_failed", "kept", "p_good")
