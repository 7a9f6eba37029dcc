import random

import pytest

from bindery.operators import hierarchy as H

SCHEMA = "doc string, id string, parent string, n int"


def walk(up):
    """Brute force: all that following parents reaches."""
    out = {}
    for doc, i in up:
        seen = [i]
        while (doc, p := up[doc, seen[-1]]) in up and p not in seen:
            seen.append(p)
            out[doc, p, i] = len(seen) - 1
    return out


@pytest.mark.parametrize("bound", [200_000, 11])
def test_descendants_on_and_below_cycles(spark, monkeypatch, bound):
    monkeypatch.setattr(H, "ROWS_PER_TASK", bound)
    r = random.Random(4)
    rows = [("a", f"n{i}", "gone" if r.random() < 0.1 else f"n{r.randrange(40)}", i) for i in range(40)]
    rows += [("b", x, p, 0) for x, p in zip("xyzuvws", ["y", "z", "x", "x", "u", None, "s"])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [(x.doc, x.rec_id, x.descendant, x.distance) for x in H.all_descendants(df, ["doc"], "id", "parent", "n").collect()]
    want = walk({(doc, i): p for doc, i, p, _ in rows})
    assert len(got) == len(want) and {g[:3]: g[3] for g in got} == want
    assert want["b", "u", "v"] == 1 and want["b", "x", "v"] == 2 and want["b", "z", "v"] == 4


def test_no_cycles_and_empty(spark):
    df = spark.createDataFrame([("a", "r", None, 1), ("a", "s", "r", 2)], SCHEMA)
    assert [tuple(x) for x in H.all_descendants(df, ["doc"], "id", "parent").collect()] == [("a", "r", "s", 1)]
    assert H.all_descendants(df.limit(0), ["doc"], "id", "parent").count() == 0
