import random

import pytest

from bindery.operators import hierarchy as H

SCHEMA = "doc string, id string, parent string, n int"


def walk(rows):
    """Brute force: follow parents one by one."""
    up = {}
    for doc, i, p, _ in rows:
        if doc is None or i is None:
            continue
        p = p or None
        old = up.get((doc, i), "none yet")
        up[doc, i] = p if old == "none yet" else (None if p is None or old is None else min(p, old))
    out = {}
    for doc, i in up:
        seen, cur = [i], i
        while True:
            p = up[doc, cur]
            if p is None:
                out[doc, i] = (cur, len(seen) - 1, "tree")
            elif (doc, p) not in up:
                out[doc, i] = (cur, len(seen) - 1, "orphan")
            elif p in seen:
                k = seen.index(p)
                out[doc, i] = (min(seen[k:]), k, "below_cycle" if k else "cycle")
            else:
                seen.append(p)
                cur = p
                continue
            break
    return out


def forest(seed, n=120):
    r = random.Random(seed)
    rows = []
    for doc in ("a", "b"):
        for i in range(n):
            kind = r.random()
            parent = None if kind < 0.08 else "gone" if kind < 0.1 else f"n{r.randrange(n)}" if kind < 0.25 else f"n{max(0, i - 1 - r.randrange(3))}"
            rows.append((doc, f"n{i}", parent, i))
    rows += [("c", "x", "x", 0), ("c", "y", "x", 1), ("c", "z", "", 2)]
    return rows


@pytest.mark.parametrize("bound", [200_000, 40, 11])
def test_equals_brute_force_at_any_task_size(spark, monkeypatch, bound):
    monkeypatch.setattr(H, "ROWS_PER_TASK", bound)
    rows = forest(3)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.doc, r.rec_id): (r.root_id, r.depth, r.state) for r in H.hierarchy(df, ["doc"], "id", "parent", "n").collect()}
    assert got == walk(rows)


@pytest.mark.parametrize("bound", [200_000, 25])
def test_paths_and_descendants(spark, monkeypatch, bound):
    monkeypatch.setattr(H, "ROWS_PER_TASK", bound)
    rows = [("d", f"k{i}", f"k{i - 1}" if i else None, (i * 37) % 100) for i in range(100)]
    tree = H.hierarchy(spark.createDataFrame(rows, SCHEMA), ["doc"], "id", "parent", "n", paths=True)
    paths = {r.rec_id: r.path for r in tree.collect()}
    assert all(paths[f"k{i}"] == [f"k{j}" for j in range(i + 1)] for i in range(100))
    below = H.descendants(tree, ["doc"]).collect()
    assert len(below) == 100 * 99 // 2
    assert {(r.rec_id, r.descendant): r.distance for r in below}["k3", "k9"] == 6


def test_empty_repeated_null_and_foreign_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert H.hierarchy(empty, ["doc"], "id", "parent").count() == 0
    rows = [("a", "r", None, 1, "x", 5), ("a", "r", None, 1, "x", 6), ("a", None, "r", 2, "x", 5), (None, "q", None, 1, "x", 5), ("a", "s", "r", None, "x", 5)]
    df = spark.createDataFrame(rows, "doc string, id string, parent string, n int, t string, depth int")
    got = {(r.doc, r.rec_id): (r.root_id, r.depth, r.state) for r in H.hierarchy(df, ["doc"], "id", "parent", "n").collect()}
    assert got == {("a", "r"): ("r", 0, "tree"), ("a", "s"): ("r", 1, "tree")}


def test_rows_of_one_id_with_different_parents(spark):
    df = spark.createDataFrame([("a", "r", None, 1), ("a", "u", "r", 2), ("a", "u", "b", 2), ("a", "b", None, 3)], SCHEMA)
    got = {r.rec_id: r.root_id for r in H.hierarchy(df, ["doc"], "id", "parent", "n").collect()}
    assert got["u"] == "b"
