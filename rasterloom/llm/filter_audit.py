"""Operator 11: audit of how filters interact, by a Walsh-Hadamard transform.

Every document has a mask of the filters that it fails.  For each part, and each label
besides, 2 ** n signed parity sums are aggregated, S[k] = sum of (-1) ** |mask & k|, with
partial sums before the one exchange.  The transform is its own inverse up to 2 ** n, so
the number of documents with each mask follows exactly.  All orders are evaluated on
these cells: ``none[U]``, the documents that fail nothing in the set U, says what is left
after the filters in U, whatever their order.  A document that fails f filters is removed
by each of them in n! / f of the n! orders, which gives the Shapley counts.

Filter E (a copy of an earlier document's text) comes from the exact dedup operator, on digests.

Defined cases: null texts are empty, and empty texts equal each other.  Null parts are the empty
string, together with parts that are one.  A row without a doc_id has no labels and is no copy, and
no row is a copy of it.  Repeated rows count each; rows that share an id share its labels; an id that
is labelled more than once has a label if one of its rows has it.  Null labels count as no label.
A document without words fails A only: 0 < 0 is false for B and C.  Empty tables give no rows.
Very long texts: a row holds its words once while it is read.  Extra columns are left out.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._frames import documents
from .exact_dedup import exact_dedup

LETTERS = "ABCDE"
LEAST_WORDS = 50
DISTINCT_PERCENT = 65
CAPITAL_PERCENT = 5


def text_failures(text: Column) -> dict[str, Column]:
    """Filters A to D: few words, few different words, many capitals, a mark."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(F.translate(text, "\x09\x0a\x0b\x0c\x0d", "\x20" * 5), "\x20"), lambda w: w != "")
    each = F.transform(F.array(words), lambda ws: F.struct(F.size(ws).alias("n"), F.size(F.array_distinct(ws)).alias("d")))[0]  # words are split once
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "words": each,
        "C": 100 * capitals > CAPITAL_PERCENT * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def parity_sums(masks: DataFrame, n: int, labels: list[str]) -> DataFrame:
    """(part, s, s_<label>...): arrays of 2 ** n signed parity sums of rows (part, mask, labels as 0 or 1)."""
    sign = {k: f"(1 - 2 * (bit_count(mask & {k}) & 1))" for k in range(1 << n)}
    kinds = {"s": "{0}", **{f"s_{x}": f"({{0}} * {x})" for x in labels}}
    sums = masks.groupBy("part").agg(*(F.expr(f"sum(cast({kind.format(sign[k])} as bigint))").alias(f"{name}{k}") for name, kind in kinds.items() for k in sign))
    return sums.select("part", *(F.array(*(f"{name}{k}" for k in sign)).alias(name) for name in kinds))


def cells_of(sums: str, n: int) -> str:
    """Documents with each mask, from their parity sums: the same transform again, divided by 2 ** n."""
    size = 1 << n
    term = "(a, k) -> a + element_at({0}, k + 1) * (1 - 2 * (bit_count(m & k) & 1))"
    return f"transform(sequence(0, {size - 1}), m -> aggregate(sequence(0, {size - 1}), 0L, {term.format(sums)}) div {size})"


def _none(cells: str, n: int) -> str:
    """For each set of filters, the documents that fail none of it."""
    size = 1 << n
    return f"transform(sequence(0, {size - 1}), u -> aggregate(sequence(0, {size - 1}), 0L, (a, m) -> a + if(m & u = 0, element_at({cells}, m + 1), 0L)))"


def interaction_audit(masks: DataFrame, letters: str = LETTERS, labels: dict[str, str] | None = None) -> DataFrame:
    """One row per part, order of the filters ``letters`` and step, of rows (part, mask, labels as 0 or 1).

    mask: bit i is set where letter i's filter fails.  labels: label -> output column of what of it is removed at a step."""
    n, labels = len(letters), labels or {}
    orders = ["".join(p) for p in itertools.permutations(letters)]
    df = parity_sums(masks, n, list(labels))
    df = df.selectExpr("part", f"{cells_of('s', n)} as c", *(f"{cells_of(f's_{x}', n)} as c_{x}" for x in labels))
    shapley = f"transform(sequence(0, {n - 1}), i -> aggregate(sequence(1, {(1 << n) - 1}), 0L, (a, m) -> a + if(m & shiftleft(1, i) = 0, 0L, element_at(c, m + 1) * ({len(orders)} div bit_count(m)))))"
    df = df.selectExpr("part", "c", f"{_none('c', n)} as none", *(f"{_none(f'c_{x}', n)} as none_{x}" for x in labels), f"{shapley} as shares")
    df = df.selectExpr("*", f"explode(split('{','.join(orders)}', ',')) as filter_order").selectExpr("*", f"explode(sequence(1, {n})) as step")
    bits = " + ".join(f"if(locate('{x}', left(filter_order, step - 1)) > 0, {1 << i}, 0)" for i, x in enumerate(letters))
    df = df.selectExpr("*", f"{bits} as before", f"locate(substring(filter_order, step, 1), '{letters}') - 1 as f")
    df = df.selectExpr("*", "before | shiftleft(1, f) as after")
    removed = "element_at(none{0}, before + 1) - element_at(none{0}, after + 1)"
    return df.selectExpr(
        "part", "filter_order", "step", "element_at(none, after + 1) as kept", f"{removed.format('')} as removed",
        f"element_at(none, 1) - element_at(none, shiftleft(1, f) + 1) - ({removed.format('')}) as redundant",
        "element_at(c, shiftleft(1, f) + 1) as unique_fails", *(f"{removed.format(f'_{x}')} as {name}" for x, name in labels.items()), "element_at(shares, f + 1) as shapley",
    )


def failure_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic) of every row of docs (doc_id, text, source)."""
    fails = text_failures(F.col("text"))
    flags = docs.select("doc_id", "text", F.coalesce("source", F.lit("")).alias("part"), *(c.alias(f"__{k}") for k, c in fails.items()))
    mask = F.expr(
        f"if(__words.n < {LEAST_WORDS}, 1, 0) | if(100L * __words.d < {DISTINCT_PERCENT}L * __words.n, 2, 0) | if(__C, 4, 0) | if(__D, 8, 0)"
    )
    flags = flags.select("doc_id", "text", "part", mask.alias("mask"))
    found = exact_dedup(flags, "smallest", ["doc_id", "part", "mask"])
    copy = F.coalesce(F.col("doc_id") > F.col("keep_id"), F.lit(False))
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(*(F.coalesce(F.max(F.when(F.col(c) == 1, 1)), F.lit(0)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))))
    both = found.withColumn("mask", F.col("mask").bitwiseOR(F.when(copy, 16).otherwise(0))).join(marks, "doc_id", "left")
    return both.select("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = failure_masks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return interaction_audit(masks, labels={"good": "good_lost", "toxic": "toxic_lost"})


SQL = """
with words as (
  select doc_id, coalesce(text, '') as t, coalesce(source, '') as part,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as ws
  from documents
), firsts as (
  select t, min(doc_id) as first_id from words group by t
), flags as (
  select part, doc_id, len(ws) < 50 as a, 100 * len(list_distinct(ws)) < 65 * len(ws) as b,
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) as c,
         regexp_matches(t, '[#$%&*|]') as d, doc_id > first_id as e
  from words join firsts using (t)
), docs as (
  select part, (case when a then 'A' else '' end || case when b then 'B' else '' end || case when c then 'C' else '' end
                || case when d then 'D' else '' end || case when e then 'E' else '' end) as fails,
         coalesce(quality = 1, false) as good, coalesce(toxic = 1, false) as toxic
  from flags left join labels using (doc_id)
), kinds as (
  select part, fails, count(*) as n, count(*) filter (where good) as g, count(*) filter (where toxic) as x from docs group by all
), letters as (
  select unnest(['A', 'B', 'C', 'D', 'E']) as l
), orders as (
  select a.l || b.l || c.l || d.l || e.l as o
  from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), removals as (
  -- the step at which each kind of document goes in each order; 6: never
  select part, fails, n, g, x, o, coalesce(list_min(list_filter([1, 2, 3, 4, 5], lambda i: contains(fails, o[i]))), 6) as gone
  from kinds, orders
), steps as (
  select unnest([1, 2, 3, 4, 5]) as step
), counted as (
  select part, o as filter_order, step, o[step] as f,
         sum(case when gone > step then n else 0 end) as kept,
         sum(case when gone = step then n else 0 end) as removed,
         sum(case when gone < step and contains(fails, o[step]) then n else 0 end) as redundant,
         sum(case when fails = o[step] then n else 0 end) as unique_fails,
         sum(case when gone = step then g else 0 end) as good_lost,
         sum(case when gone = step then x else 0 end) as toxic_lost
  from removals, steps group by part, o, step
)
select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant,
       unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
       (sum(removed) over (partition by part, f))::bigint as shapley
from counted
"""
