"""Problems 5 and 6 on small fixtures."""

import os
import random

import pytest

from bindery.llm import names, tokens

NAME = "id bigint, name string, key string"
PATH = os.path.join(os.environ.get("BINDERY_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")


def groups(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], NAME)
    by = {}
    for r in names.entities(df, "id", "name").collect():
        by.setdefault(r.entity, set()).add(r.name)
    return by.values()


PEOPLE = ["Marta Logrunpiste", "Logrunpiste, Marta", "M. Logrunpiste", "Logrunpiste M", "Marta Logrunpsite", "MARTA LOGRUNPISTE", "Mar. Logrunpiste", "Dr. Marta Logrunpiste", "Мarta Logrunpiste", "Marta Oskar Logrunpiste"]
ROBERT = ["Bob Gorbungisbra", "Robert Gorbungisbra", "Gorbungisbra, R."]
RELATIVE = ["Zachary Logrunpiste", "Logrunpiste, Zak"]
HOUSE = ["Tunriszake Laboratory of Rural Economics", "Laboratory of Rural Economics, Tunriszake", "Lab. of Rural Econ. (Tunriszake)", "Tunriszake LRE", "The Tunriszake Lab. of Rural Econ. Ltd.", "TUNRISZAKE LABORATORY OF RURAL ECONOMICS"]
FILL = [f"{s}, {g}" for s in ("Abelgor", "Bisnarun", "Corvelti") for g in ("Marta", "Robert", "Zachary", "Oskar")]


def test_variants_are_linked_and_relatives_are_not(spark):
    by = list(groups(spark, PEOPLE + ROBERT + RELATIVE + HOUSE + FILL))
    for want in (PEOPLE, ROBERT, RELATIVE, HOUSE):
        assert set(want) in by


def test_nobody_null_blank_and_repeated(spark):
    df = spark.createDataFrame([(1, "Anonymous", "a"), (2, "N. N.", "a"), (3, None, "a"), (4, " ", "a"), (5, "Marta Abelgor", "a"), (6, "Abelgor, Marta", "a"), (6, "Abelgor, Marta", "b"), (7, "Marta Abelgor", "a")], NAME)
    assert {tuple(r) for r in names.pairs(df, "id", "name").collect()} == {(5, 6), (6, 7)}
    assert names.pairs(df.limit(0), "id", "name").count() == 0


def test_trie_finds_all_neighbours():
    r = random.Random(1)
    words = list({"".join(r.choice("abc") for _ in range(r.randrange(1, 8))) for _ in range(400)})
    trie = names.Trie(words)

    def dist(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
            row = new
        return row[-1]

    for w in words[:40]:
        assert dict(trie.near(w, 2)) == {x: dist(w, x) for x in words if dist(w, x) <= 2}


def test_trie_join_equals_brute_force(spark):
    r = random.Random(2)
    words = list({"".join(r.choice("abcd") for _ in range(r.randrange(7, 11))) for _ in range(500)})
    got = {tuple(sorted(x)) for x in names.near_keys(spark.createDataFrame([(w,) for w in words], "key string")).collect()}
    trie = names.Trie(words)
    assert got == {tuple(sorted((a, b))) for a in words for b, _ in trie.near(a, 2) if a != b} and got


@pytest.fixture(scope="module")
def encoder():
    if not os.path.exists(PATH):
        pytest.skip("no tokenizer file")
    return tokens.Encoder(tokens.ranks_of(PATH))


def test_perfect_hash_is_minimal_and_exact(encoder):
    keys = list(encoder.ranks)
    assert encoder.table.get(keys) == [encoder.ranks[k] for k in keys]
    assert encoder.table.get([b"\x00surely not a token", b""]) == [-1, -1]
    assert len(encoder.table.keys) == len(keys) and all(k is not None for k in encoder.table.keys)


def test_equals_the_public_library(encoder):
    import tiktoken

    e = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
    r = random.Random(3)
    texts = ["", " ", "Hello world's  end\n\n", "naïve 東京 👍🏽 ‍ x²", "<|endoftext|>", "a" * 5000, "\t\r\n  x", "".join(chr(r.randrange(32, 0xD7FF)) for _ in range(3000)), "ab" * 3001 + "é" * 999]
    assert encoder.encode(texts) == [e.encode_ordinary(t) for t in texts]
    assert [e.decode(x) for x in encoder.encode(texts)] == texts


def test_one_row_for_each_key(spark, encoder):
    df = spark.createDataFrame([(1, "a b", 5), (1, "a b", 6), (2, None, 5), (3, "", 5), (None, "x", 5)], "doc_id bigint, text string, ids int")
    got = {r.doc_id: list(r.ids) for r in tokens.encode(df, "doc_id", "text", PATH).collect()}
    assert got == {1: encoder.encode(["a b"])[0], 2: [], 3: [], None: encoder.encode(["x"])[0]}
    assert tokens.encode(df.limit(0), "doc_id", "text", PATH).count() == 0
