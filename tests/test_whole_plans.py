import random

import pytest

from bindery.operators import hierarchy as H
from bindery.operators import plan

SCHEMA = "doc_id string, ord int, node_id string, parent_id string, title string, dest int"


def rows_of(seed, n=90):
    r = random.Random(seed)
    rows = []
    for doc in ("a", "b"):
        for i in range(n):
            kind = r.random()
            parent = None if kind < 0.06 else "gone" if kind < 0.1 else f"n{r.randrange(n)}" if kind < 0.16 else f"n{max(0, i - 1 - r.randrange(3))}"
            rows.append((doc, i, f"n{i}", parent, "t", None if r.random() < 0.5 else i))
    chain = [("c", i, f"k{i}", f"k{i - 1}" if i else "", "t", 1 if i in (0, 39) else None) for i in range(40)]
    ring = [("d", 0, "x", "y", "t", None), ("d", 1, "y", "x", "t", 1), ("d", 2, "z", "x", "t", 1), ("d", 3, "s", "s", "t", 1)]
    odd = [("e", 0, "u", None, "t", 1), ("e", 1, "v", "u", "t", 1), ("e", 1, "v", "u", "other title", 1), ("e", 1, "v", "u", "third", None), ("e", 2, "", "v", "t", 1), ("e", 3, None, "u", "t", 1), (None, 0, "u", "v", "t", 1)]
    return rows + chain + ring + odd


def promoted(rows):
    """Brute force: follow parents one by one."""
    up, has = {}, set()
    for doc, _, i, p, _, dest in rows:
        if doc is not None and i is not None:
            up[doc, i] = p or None
            has |= {(doc, i)} if dest is not None else set()
    out = []
    for doc, _, i, _, _, dest in rows:
        seen, found, cur = {i}, None, up.get((doc, i))
        while cur is not None and (doc, cur) in up and cur not in seen:
            seen.add(cur)
            found = cur if found is None and (doc, cur) in has else found
            cur = up[doc, cur]
        if dest is not None and (cur is None or cur not in seen):
            out.append((doc, i, found))
    return out


@pytest.mark.parametrize("bound", [200_000, 11])
def test_promotion_equals_brute_force_and_sends_no_table_to_the_driver(spark, monkeypatch, bound):
    monkeypatch.setattr(H, "ROWS_PER_TASK", bound)
    plans = []
    for m, name in ((H, "cut"), (H, "kept"), (plan, "kept")):
        whole = getattr(m, name, None)
        monkeypatch.setattr(m, name, lambda df, whole=whole: (plans.append(df._jdf.queryExecution().executedPlan().toString()), whole(df))[1], raising=False)
    rows = rows_of(5)
    got = plan.promote(spark.createDataFrame(rows, SCHEMA).distinct())
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 5 and not [p for p in plans if "BroadcastExchange" in p]
    key = lambda x: tuple((v is not None, v or "") for v in x)
    assert sorted((tuple(x) for x in got.select("doc_id", "node_id", "parent_id").collect()), key=key) == sorted(promoted(rows), key=key)
