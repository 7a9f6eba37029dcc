"""Surnames of one and two letters."""

import itertools
import random

from bindery.llm import names

SAME = ["Li, Wei", "Wei Li", "LI, WEI", "Li W", "W. Li"]
OTHER = ["Lu, Wei", "Wu, Marta", "Marta Wu", "Lu, Marta"]


def test_short_surnames_are_linked_exactly(spark):
    texts = SAME + OTHER + ["李明", "Ng", "NG", "Society of Maps, Bo", "Bo Society of Maps"]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, name string")
    by = {}
    for r in names.entities(df, "id", "name").collect():
        by.setdefault(r.entity, set()).add(r.name)
    assert set().union(*by.values()) == set(texts)
    assert sorted(by.values(), key=sorted) == sorted([set(SAME), {"Lu, Wei"}, {"Lu, Marta"}, {"Wu, Marta", "Marta Wu"}, {"李明"}, {"Ng", "NG"}, {"Society of Maps, Bo", "Bo Society of Maps"}], key=sorted)
    got = {tuple(r) for r in names.pairs(df, "id", "name").collect()}
    assert (0, 1) in got and (0, 5) not in got


def test_one_letter(spark):
    assert names.Reader({"jiho"}).read("O, Jiho")[0] == "o"
    assert set(names.near_keys(spark.createDataFrame([("li",), ("lu",), ("o",), ("lin",)], "key string")).collect()) == set()


def test_divided_shards_find_the_same_pairs(spark):
    r = random.Random(4)
    words = list({"ma" + "".join(r.choice("abcd") for _ in range(r.randrange(2, 7))) for _ in range(300)})
    keys = spark.createDataFrame([(w,) for w in words], "key string")
    want = {(a, b) for a, b in itertools.combinations(sorted(words), 2) if names.Trie([b]).near(a, 2 if max(len(a), len(b)) > 6 else 1)}
    for bound in (3, 2000):
        assert {tuple(sorted(x)) for x in names.near_keys(keys, bound=bound).collect()} == want


def test_keys_below_a_follower_go_on_to_its_leader(spark):
    keys = spark.createDataFrame([("abcdefghij", 10), ("abcdefghxy", 3), ("zwcdefghxy", 1), ("other", 5)], "key string, n long")
    assert {r.key: r.lead for r in names.leaders(keys).collect()} == {"abcdefghij": "abcdefghij", "abcdefghxy": "abcdefghij", "zwcdefghxy": "abcdefghij", "other": "other"}


def test_other_token_orders(spark):
    texts = ["Velmorka, Tiskun Baro", "Velmorka, T. B.", "Velmorca, Tiskun", "Tiskun Velmorka Baro", "Abelgor, Marta", "Abelgor, Oskar"]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, name string")
    of = {r.name: r.entity for r in names.entities(df, "id", "name").collect()}
    assert len({of[t] for t in texts[:4]}) == 1 and len(set(of.values())) == 3


def test_banded_automaton_on_long_words():
    long = "ab" * 3000
    assert names.Trie([long, long[1:], "x" + long[:-1]]).near(long, 2) and names.Trie(["a"]).near(long, 2) == []
