"""What each filter removes in every order of the filters, from decision diagrams (operator 12).

Every document fails some of the filters. The failures are counted per part of the corpus, which leaves at most 2^n rows a part for n filters. From
these a diagram is built for each part: a level per filter, a passing and a failing branch per node, equal branches shared, and the
counts at the ends. The filters are brought into all orders one swap of adjacent levels at a time (the order of plain changes), each of which rebuilds two levels.
In each order the path of passing branches from the root gives the steps: the failing branch of its k-th node holds what the k-th filter removes.

``document_failures`` finds the failures of five filters: A few words, B few distinct words, C many capitals, D symbols, E an exact copy of a document with a
smaller id anywhere in the table. Texts are compared by SHA-256.

Defined results: a null text is empty, a null part is the empty string. A null ``doc_id`` is neither smaller nor larger than any and has no
labels. Rows that repeat an id and text are no copies of each other. A document is good (toxic) if any row of the labels with its id says so. An empty table
gives no row. Only ``doc_id``, ``text`` and ``lang``, and of the labels ``doc_id``, ``quality`` and ``toxic``, are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from specledger.llm.copies import join_copies
from specledger.llm.words import words
from specledger.session import stage_table

FILTERS = "ABCDE"
EXAMINED = StructType([StructField("mask", IntegerType()), StructField("digest", BinaryType())])
SYMBOLS = re.compile(r"[#$%&*|]")
CAPITALS = bytes(range(65, 91))
STEPS = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, "
         "shapley long")


def text_mask(text: str | None) -> int:
    """Bits of the filters A to D that a text fails."""
    found = words(text)
    n, data = len(found), (text or "").encode("utf-8", "surrogatepass")
    capitals = len(data) - len(data.translate(None, CAPITALS))
    return ((n < 200) | (100 * len(set(found)) < 50 * n) << 1 | (100 * capitals > 3 * len(text or "")) << 2
            | (SYMBOLS.search(text or "") is not None) << 3)


@F.pandas_udf(EXAMINED)
def examined(texts: pd.Series) -> pd.DataFrame:
    texts = [t if isinstance(t, str) else "" for t in texts]
    return pd.DataFrame({"mask": [text_mask(t) for t in texts], "digest": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in texts]})


def document_failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part``, ``mask`` (a bit per filter), ``good`` and ``toxic`` of every document, with the number ``n`` of such rows.

    Rows that agree in all that matters are counted before anything is joined; rows without an id join nothing.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), examined("text").alias("t"))
    found = stage_table(rows.select("doc_id", "part", "t.mask", "t.digest"), "text-failures")
    groups = stage_table(found.groupBy("digest").agg(F.count("doc_id").alias("copies"), F.min("doc_id").alias("first")).filter("copies > 1"), "copies")
    named = found.filter("doc_id is not null")
    copy_rows = join_copies(named.select("doc_id", "digest"), groups, "digest")
    copies = copy_rows.filter("doc_id > first").select("doc_id", "digest").distinct()
    ids = named.groupBy("doc_id", "part", "mask", "digest").agg(F.count(F.lit(1)).alias("n"))
    e = 1 << FILTERS.index("E")
    marked = ids.join(copies.withColumn("copy", F.lit(e)), ["doc_id", "digest"], "left")
    says = labels.filter("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    known = marked.join(says, "doc_id", "left").select(
        "part", (F.col("mask") + F.coalesce("copy", F.lit(0))).alias("mask"), F.coalesce("good", F.lit(False)).alias("good"),
        F.coalesce("toxic", F.lit(False)).alias("toxic"), "n")
    return known.unionByName(found.filter("doc_id is null").select(
        "part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic"), F.lit(1).cast("long").alias("n")))


class Diagram:
    """A decision diagram whose ends are counts. A node is a pair of branches, (passing, failing); its total is kept beside it."""

    def __init__(self, weights: np.ndarray, variables: str):
        """``weights`` has a row of counts for each mask, the first variable being the lowest bit."""
        self.order = list(variables)
        self.levels: list[dict[tuple[int, int], int]] = [{} for _ in variables]
        ends, place = np.unique(weights, axis=0, return_inverse=True)
        self.totals = [list(ends)]  # from the ends up: the totals of the nodes of a level
        self.branches: list[list[tuple[int, int]]] = []
        below = place.reshape(-1)
        # The last level decides the last variable, which is the highest bit.
        for _ in variables:
            half = len(below) // 2
            below = self._level(list(zip(below[:half].tolist(), below[half:].tolist())), len(self.totals) - 1)
        self.root = int(below[0])

    def _level(self, pairs: list[tuple[int, int]], under: int, at: int | None = None) -> np.ndarray:
        """Store a level above the level ``under`` with equal nodes shared; the place of each pair in it."""
        known: dict[tuple[int, int], int] = {}
        places = np.array([known.setdefault(p, len(known)) for p in pairs])
        totals = [self.totals[under][a] + self.totals[under][b] for a, b in known]
        if at is None:
            self.branches.append(list(known))
            self.totals.append(totals)
        else:
            self.branches[at], self.totals[at + 1] = list(known), totals
        return places

    def swap(self, k: int) -> None:
        """Exchange the k-th filter from the top with the next. Only these two levels change."""
        upper = len(self.order) - 1 - k
        lower = upper - 1
        low, nodes = self.branches[lower], self.branches[upper]
        crossed = [pair for a, b in nodes for pair in zip(low[a], low[b])]
        places = self._level(crossed, lower, lower).tolist()
        # The nodes of the upper level keep their places: the levels above point to them.
        self.branches[upper] = list(zip(places[::2], places[1::2]))
        self.order[k], self.order[k + 1] = self.order[k + 1], self.order[k]

    def steps(self) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        """Filter, counts kept and counts removed along the path of passing branches."""
        node = self.root
        for k, name in enumerate(self.order):
            level = len(self.order) - 1 - k
            node, failing = self.branches[level][node]
            yield name, self.totals[level][node], self.totals[level][failing]


def plain_changes(n: int) -> Iterator[int]:
    """Places of the swaps of neighbours that lead through all orders of n things, each order once."""
    if n < 2:
        return
    inner = plain_changes(n - 1)
    down = True
    for _ in range(factorial(n - 1)):
        yield from (range(n - 2, -1, -1) if down else range(n - 1))
        step = next(inner, None)
        if step is not None:
            yield step + down  # while the last thing stands in front, the others are one further on
        down = not down


def audit_part(counts: pd.DataFrame, filters: str) -> pd.DataFrame:
    """All steps of all orders of one part, from its rows ``mask``, ``n``, ``good``, ``toxic``."""
    weights = np.zeros((1 << len(filters), 3), np.int64)
    weights[counts["mask"].to_numpy()] = counts[["n", "good", "toxic"]].to_numpy()
    masks = np.arange(len(weights))
    fails = {f: int(weights[masks >> i & 1 == 1, 0].sum()) for i, f in enumerate(filters)}
    alone = {f: int(weights[1 << i, 0]) for i, f in enumerate(filters)}
    diagram = Diagram(weights, filters)
    out, shares = [], dict.fromkeys(filters, 0)
    for swap in [None, *plain_changes(len(filters))]:
        if swap is not None:
            diagram.swap(swap)
        order = "".join(diagram.order)
        for step, (name, kept, removed) in enumerate(diagram.steps(), 1):
            shares[name] += int(removed[0])
            out.append((order, step, kept[0], removed[0], fails[name] - removed[0], alone[name], removed[1], removed[2]))
    frame = pd.DataFrame(out, columns=["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"])
    frame["shapley"] = [shares[order[step - 1]] for order, step in zip(frame["filter_order"], frame["step"])]
    return frame


def audit_filters(failures: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step.

    ``failures`` has ``part``, ``mask`` (bit i: fails the i-th filter), ``good``, ``toxic`` and a number ``n`` of such documents. All n! orders are
    written, so the filters are few.
    """
    counted = failures.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))

    def audited(part: tuple, counts: pd.DataFrame) -> pd.DataFrame:
        out = audit_part(counts, filters)
        out.insert(0, "part", part[0])
        return out

    return counted.groupBy("part").applyInPandas(audited, STEPS)


def oracle() -> str:
    """The same rows of ``audit_filters(document_failures(documents, labels))`` as SQL."""
    return r"""
with t as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words from t),
firsts as (select text, min(doc_id) as first from t group by text),
says as (select doc_id, bool_or(coalesce(quality = 1, false)) as good, bool_or(coalesce(toxic = 1, false)) as toxic from labels group by doc_id),
f as (select part, len(words) < 200 as a, 100 * len(list_distinct(words)) < 50 * len(words) as b,
    100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text) as c, regexp_matches(text, '[#$%&*|]') as d,
    coalesce(w.doc_id > first, false) as e, coalesce(good, false) as good, coalesce(toxic, false) as toxic
  from w left join firsts using (text) left join says on says.doc_id = w.doc_id),
m as (select part, a::int + 2 * b::int + 4 * c::int + 8 * d::int + 16 * e::int as mask, count(*) as n, count(*) filter (good) as good,
    count(*) filter (toxic) as toxic from f group by all),
bit as (select chr(65 + i) as name, 1 << i as v from (select unnest(range(5))::int as i)),
orders as (select p1.name || p2.name || p3.name || p4.name || p5.name as filter_order from bit p1, bit p2, bit p3, bit p4, bit p5
  where p1.v + p2.v + p3.v + p4.v + p5.v = 31 and p1.v | p2.v | p3.v | p4.v | p5.v = 31),
steps as (select filter_order, step, v, (select coalesce(sum(b.v), 0) from bit b where strpos(filter_order, b.name) < step) as earlier
  from orders, (select unnest(range(1, 6)) as step) join bit on name = substr(filter_order, step, 1)),
r as (select part, filter_order, step, v,
    coalesce(sum(n) filter (mask & (earlier + v)::int = 0), 0) as kept, coalesce(sum(n) filter (mask & earlier::int = 0 and mask & v > 0), 0) as removed,
    coalesce(sum(n) filter (mask & earlier::int > 0 and mask & v > 0), 0) as redundant, coalesce(sum(n) filter (mask = v), 0) as unique_fails,
    coalesce(sum(good) filter (mask & earlier::int = 0 and mask & v > 0), 0) as good_lost,
    coalesce(sum(toxic) filter (mask & earlier::int = 0 and mask & v > 0), 0) as toxic_lost
  from m, steps group by part, filter_order, step, v)
select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant,
  unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
  (sum(removed) over (partition by part, v))::bigint as shapley from r"""
