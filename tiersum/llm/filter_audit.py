"""Interaction audit of filters: what each one removes in every order of applying them, and its Shapley share.

Documents are counted once, in cells of equal filter masks. Orders are then visited by adjacent transpositions: two
neighbouring filters change places, so that only their two steps are counted anew from the cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Orders grow with the factorial, 40,320 for eight filters; more are refused.
MAX_FILTERS = 8


def text_failures(text: Column) -> dict[str, Column]:
    """Conditions of failure of a text that isn't null. A: short, B: few distinct words, C: capitals, D: symbols."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 50 * F.size(words).cast("long"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 3 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


#: Failing E: the same text as a document of smaller id.
COPIES = "E"


def mark(docs: DataFrame, failures=text_failures, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """docs -> (doc_id, part, digest, mask): the bits of the conditions that each whole text fails, in their order. Null text and part are empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    bits = [c.cast("int") * (1 << k) for k, c in enumerate(failures(text).values())]
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.sha2(text.cast("binary"), 256).alias("digest"), sum(bits[1:], bits[0]).alias("mask"))


def cells(marked: DataFrame, labels: DataFrame, filters: int, id_col: str = "doc_id") -> DataFrame:
    """marked(doc_id, part, digest, mask), labels(doc_id, quality, toxic) -> (part, mask, n, good, toxic), with one bit more, for copies.

    A row is a copy if its text is that of a smaller id anywhere. Rows of one text meet as counts by part, label and mask with their smallest id, so
    that a text of a third of all rows is a few counts. A row without id is never a copy; of several labels of one id any 1 counts.
    """
    told = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"), F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"))
    once = marked.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    rows = once.join(told, "doc_id", "left").select("doc_id", "part", "digest", "mask", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    groups = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNotNull(), F.col("n"))).alias("named"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("n_first"))
    smallest = F.min("first").over(Window.partitionBy("digest"))
    copies = F.coalesce(F.col("named") - F.when(F.col("first") == smallest, F.col("n_first")).otherwise(0), F.lit(0))
    split = groups.withColumn("copies", copies).select("part", "good", "toxic", F.explode(F.array(F.struct("mask", (F.col("n") - F.col("copies")).alias("n")), F.struct((F.col("mask") + (1 << (filters - 1))).alias("mask"), F.col("copies").alias("n")))).alias("c"))
    n = F.col("c.n")
    return split.filter(n > 0).groupBy("part", F.col("c.mask").alias("mask")).agg(F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic"))


def adjacent_swaps(k: int) -> Iterator[int]:
    """Places i such that swapping i and i + 1, one after another, visits each order of k things once."""
    if k < 2:
        return
    inner, down = adjacent_swaps(k - 1), True
    while True:
        yield from range(k - 2, -1, -1) if down else range(k - 1)  # the last thing walks through the others
        step = next(inner, None)
        if step is None:
            return
        yield step + 1 if down else step  # the others move by one while it stands at an end
        down = not down


def walk_orders(counts: np.ndarray, filters: int) -> Iterator[tuple[tuple[int, ...], list[tuple[int, ...]], np.ndarray | None]]:
    """counts(2^filters, 3) of documents, good and toxic ones by mask -> for each order of filters its steps (kept, removed, redundant, good, toxic).

    The third value is None but for the last order: there, each filter's removals summed over all orders.
    """
    masks = np.arange(1 << filters)
    fails = [int(counts[masks >> f & 1 == 1, 0].sum()) for f in range(filters)]
    order, steps = list(range(filters)), [()] * filters
    visit, since, shares = 0, np.zeros(filters, np.int64), np.zeros(filters, np.int64)

    def step(at: int) -> tuple[int, ...]:
        f, before = order[at], sum(1 << g for g in order[:at])
        reached = masks & before == 0
        n, good, toxic = (int(x) for x in counts[reached & (masks >> f & 1 == 1)].sum(axis=0))
        return int(counts[reached & (masks >> f & 1 == 0), 0].sum()), n, fails[f] - n, good, toxic

    steps = [step(at) for at in range(filters)]
    swaps = adjacent_swaps(filters)
    while True:
        swap = next(swaps, None)
        if swap is None:
            for at, f in enumerate(order):
                shares[f] += steps[at][1] * (visit + 1 - since[f])
            yield tuple(order), list(steps), shares
            return
        yield tuple(order), list(steps), None
        visit += 1
        for at in (swap, swap + 1):
            f = order[at]
            shares[f] += steps[at][1] * (visit - since[f])
            since[f] = visit
        order[swap], order[swap + 1] = order[swap + 1], order[swap]
        steps[swap], steps[swap + 1] = step(swap), step(swap + 1)


AUDIT = "part string, filter_order string, step int, filter string, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(counted: DataFrame, names: str) -> DataFrame:
    """cells(part, mask, n, good, toxic) -> one row per part, order of the filters and step. A part is at most 2^filters cells, in one task."""
    k = len(names)
    if k > MAX_FILTERS:
        raise ValueError(f"more than {MAX_FILTERS} filters: an order each would be too many rows")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros((1 << k, 3), np.int64)
        counts[part["mask"].to_numpy()] = part[["n", "good", "toxic"]].to_numpy()
        rows, shares = [], None
        for order, steps, shares in walk_orders(counts, k):
            text = "".join(names[f] for f in order)
            rows += [(text, at + 1, f, *steps[at]) for at, f in enumerate(order)]
        out = pd.DataFrame(rows, columns=["filter_order", "step", "f", "kept", "removed", "redundant", "good_lost", "toxic_lost"])
        f = out.pop("f").to_numpy()
        return out.assign(part=part["part"].iloc[0], filter=np.array(list(names))[f], unique_fails=counts[1 << f, 0], shapley=shares[f])[[c.split()[0] for c in AUDIT.split(", ")]]

    return counted.groupBy("part").applyInPandas(run, AUDIT)


def audit_documents(docs: DataFrame, labels: DataFrame, failures=text_failures, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """docs, labels(doc_id, quality, toxic) -> the audit of the conditions and of copies, whose letter is E, by part.

    Every part has a row for each order and step, zeros included; an empty table gives none. Null texts and parts are empty ones. Repeated rows
    count as often as they are there; other columns are ignored.
    """
    names = "".join(failures(F.lit(""))) + COPIES
    return audit(cells(mark(docs, failures, id_col, text_col, part_col), labels, len(names), id_col), names)


#: The audit of `documents` and `labels` in DuckDB.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
told AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [
    len(words) < 200,
    100 * len(list_distinct(words)) < 50 * len(words),
    100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t),
    regexp_matches(t, '[#$%&*|]'),
    coalesce(w.doc_id > first, false)] AS fails FROM w LEFT JOIN told ON told.doc_id = w.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY 1, 2),
f AS (SELECT unnest(range(1, 6)) AS k),
o AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS ks FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT ks, array_to_string(list_transform(ks, lambda x: substr('ABCDE', x::INT, 1)), '') AS filter_order, unnest(range(1, 6)) AS step FROM o),
r AS (SELECT part, filter_order, step, ks[step] AS k, n, good, toxic, fails[ks[step]] AS fail, len(list_filter(ks[1:step-1], lambda x: fails[x])) > 0 AS gone, len(list_filter(fails, lambda x: x)) = 1 AS alone FROM c, s),
g AS (SELECT part, filter_order, step, k,
    sum(CASE WHEN NOT gone AND NOT fail THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND fail THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN gone AND fail THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fail AND alone THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT gone AND fail THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND fail THEN toxic ELSE 0 END) AS toxic_lost
    FROM r GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step::INT AS step, substr('ABCDE', k::INT, 1) AS filter, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
    good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley FROM g
"""
