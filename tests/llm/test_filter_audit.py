import itertools
import math
import random
import re

import duckdb
import numpy as np
import pytest

from tiersum.llm import filter_audit

DOCS = "doc_id long, text string, lang string, mask string, n string, part string, good string"


def documents():
    rng = random.Random(6)
    pool = [" ".join(f"{rng.choice(['w', 'W', 'a#'])}{rng.randrange(rng.choice([3, 400]))}" for _ in range(rng.choice([5, 150, 260]))) for _ in range(40)]
    rows = [(i, rng.choice(pool), rng.choice(["aa", "bb", None, ""])) for i in range(200)]
    rows += [(500, None, "aa"), (501, "", None), (502, " \n ", "cc"), (None, pool[0], "aa"), (None, pool[0], "aa"), (3, rows[3][1], rows[3][2]), (503, "É" * 2_000 + "ABC", "bb"), (-4, rows[9][1], "bb"), (504, "long " * 50_000, "bb")]
    return [(*r, "x", "x", "x", "x") for r in rows]


LABELS = [(i, i % 3 % 2, int(i % 7 == 0)) for i in range(0, 200, 2)] + [(4, 1, None), (None, 1, 1), (502, None, 1), (9_999, 1, 1)]


def brute(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    own = []
    for i, text, part, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        copy = i is not None and any(j is not None and j < i and (u or "") == text for j, u, *_ in rows)
        fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search(r"[#$%&*|]", text)), copy]
        own.append((part or "", dict(zip("ABCDE", fails)), i in good, i in toxic))
    out, total = [], {}
    for part in {p for p, *_ in own}:
        docs = [d for d in own if d[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[1][f]]
                before, left = left, [d for d in left if not d[1][f]]
                failing = [d for d in docs if d[1][f]]
                total[part, f] = total.get((part, f), 0) + len(gone)
                out.append((part, order, step, f, len(left), len(gone), len(failing) - len(gone), sum(sum(d[1].values()) == 1 for d in failing), sum(d[2] for d in gone), sum(d[3] for d in gone)))
    return sorted((*r, total[r[0], r[3]]) for r in out)


@pytest.mark.parametrize("k", range(1, 7))
def test_swaps_visit_each_order_once(k):
    order, seen = list(range(k)), {tuple(range(k))}
    for i in filter_audit.adjacent_swaps(k):
        order[i], order[i + 1] = order[i + 1], order[i]
        seen.add(tuple(order))
    assert len(seen) == math.factorial(k) == 1 + sum(1 for _ in filter_audit.adjacent_swaps(k))


def test_audit_equals_brute_force_and_sql(spark):
    rows = documents()
    docs, labels = spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = filter_audit.audit_documents(docs, labels)
    values = sorted(map(tuple, got.collect()))
    assert values == brute(rows, LABELS)
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.register("labels", labels.toArrow())
    told = con.execute(filter_audit.SQL).df()
    assert sorted(tuple(r) for r in told[got.columns].itertuples(index=False)) == values
    assert filter_audit.audit_documents(docs.limit(0), labels).count() == 0
    assert filter_audit.audit_documents(docs, labels.limit(0)).count() == len(values)


def test_shapley_shares_add_up():
    counts = np.random.default_rng(1).integers(0, 50, (16, 3))
    visits = list(filter_audit.walk_orders(counts, 4))
    assert len(visits) == 24 and sum(visits[-1][2]) == 24 * counts[1:, 0].sum()


def test_too_many_filters(spark):
    counted = spark.createDataFrame([], "part string, mask int, n long, good long, toxic long")
    with pytest.raises(ValueError):
        filter_audit.audit(counted, "ABCDEFGHI")
