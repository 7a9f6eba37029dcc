"""Problem 5: spellings of names that mean one person or organisation.

A name is read as a key (the surname, or the proper name of an organisation)
and what stands beside it (given names, initials, kind and subject). Which
tokens are given names is learned from the names with a comma. Keys are joined
on edit distance by tries: every key goes into the shards of its parts, keys of
near length look up the shards of the parts that two edits can't all break,
and a Levenshtein automaton walks the shard's trie. Shards of more than
``SHARD`` keys are divided: each piece of the stored keys meets each piece of
those that look up. A key follows the most frequent key near it, and that one
its own, up to a key that follows none.

A name whose key nobody else has is read in its other token orders too, and
takes the order whose key is near the most frequent one.

Below one surname given names are joined, not compared with each other: which
given names are alike (edits, by the same trie join; beginnings; nicknames) is
found once over all distinct ones, and these pairs are joined with the names
below each surname. Initials and abbreviations are joined with counts of the
given names that fit. No step gathers a surname in one task.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.llm.leaks import HIDDEN, SEEN
from bindery.session import cut, partitions

EDITS = 2
PARTS = EDITS + 1
GIVEN_SHARE = 1e-4
SHARD = 2000
BROADCAST = 1 << 20  # rows, beyond which a side is shuffled

# Nicknames and the given names they stand for.
NICKNAMES = {
    "al": "albert alan alexander", "alex": "alexander alexandra", "andy": "andrew", "ann": "anna", "annie": "anna anne", "art": "arthur", "barb": "barbara", "becky": "rebecca", "bella": "isabella", "ben": "benjamin", "bert": "albert herbert robert", "beth": "elizabeth", "betsy": "elizabeth", "betty": "elizabeth", "bill": "william", "billy": "william", "bob": "robert", "bobby": "robert",
    "cathy": "catherine katherine", "charlie": "charles", "chris": "christopher christine", "chuck": "charles", "dan": "daniel", "dave": "david", "debbie": "deborah", "dick": "richard", "dima": "dmitri", "dolly": "dorothea dorothy", "dora": "theodora dorothea", "dot": "dorothea dorothy", "ed": "edward", "eddie": "edward", "ellie": "eleanor", "fran": "francesca frances", "frank": "francis", "fred": "frederick", "freddy": "frederick", "fritz": "friedrich frederick",
    "gene": "eugene", "greg": "gregory", "gus": "augustus gustav", "hal": "harold henry", "hank": "henry", "hans": "johannes", "harry": "harold henry", "jack": "john", "jake": "jacob", "jan": "johannes", "jerry": "gerald", "jim": "james", "jimmy": "james", "joe": "joseph", "joey": "joseph", "johnny": "john", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "kit": "katherine christopher",
    "larry": "lawrence", "lena": "helena magdalena", "leo": "leonard", "lisa": "elizabeth", "liv": "olivia", "liz": "elizabeth", "liza": "elizabeth", "maggie": "margaret", "mandy": "amanda", "matt": "matthew", "meg": "margaret", "mick": "michael", "mike": "michael", "misha": "mikhail michael", "molly": "mary", "nat": "nathaniel", "nate": "nathaniel", "ned": "edward", "nell": "eleanor helen", "nick": "nicholas",
    "pat": "patricia patrick", "patty": "patricia", "peggy": "margaret", "pete": "peter", "phil": "philip", "polly": "mary", "ray": "raymond", "rick": "richard", "rob": "robert", "ron": "ronald", "sally": "sarah", "sam": "samuel samantha", "sandy": "alexander", "sasha": "alexander", "sepp": "joseph josef", "steve": "stephen", "sue": "susanna susan", "susie": "susanna susan", "ted": "edward theodore", "tess": "theresa", "thea": "dorothea theodora", "theo": "theodore theodora", "tim": "timothy", "toby": "tobias", "tom": "thomas", "tommy": "thomas", "tony": "anthony", "trish": "patricia", "uli": "ulrike ulrich", "vanya": "ivan", "vicky": "victoria", "wally": "walter", "walt": "walter", "will": "william", "willy": "william", "zach": "zachary", "zack": "zachary", "zak": "zachary",
}
# Names that name nobody.
NOBODY = {"", "anonymous", "anon", "unknown", "n n", "nn", "na", "n a", "none", "null", "various", "various authors", "author unknown", "unknown author", "no author", "et al", "tba", "tbd", "editor", "anonym", "verschiedene", "unbekannt", "autor", "author", "diverse"}
# Titles, roles and legal forms that belong to no name.
AROUND = {"dr", "prof", "professor", "mr", "mrs", "ms", "sir", "dame", "phd", "ph", "md", "hrsg", "hg", "ed", "eds", "editor", "editors", "by", "von", "the", "ltd", "inc", "ev", "e v", "gmbh", "jr", "sr", "author", "translator", "transl", "trans", "llc", "plc", "co"}
# Kinds of organisations and their abbreviations, and words between their parts.
KINDS = {"society": "society", "soc": "society", "institute": "institute", "inst": "institute", "academy": "academy", "acad": "academy", "laboratory": "laboratory", "lab": "laboratory", "department": "department", "dept": "department", "association": "association", "assn": "association", "assoc": "association", "council": "council", "university": "university", "univ": "university", "museum": "museum", "committee": "committee", "centre": "centre", "center": "centre", "college": "college", "library": "library", "office": "office", "bureau": "bureau", "foundation": "foundation", "school": "school"}
LINKS = {"of", "for", "on", "and", "at", "in", "de", "der", "fur", "des"}


class Trie:
    """Strings by their letters, walked with a Levenshtein automaton whose state is a row of distances."""

    def __init__(self, words: list[str]):
        self.root: dict = {}
        for w in words:
            node = self.root
            for ch in w:
                node = node.setdefault(ch, {})
            node[""] = w

    def near(self, word: str, most: int) -> list[tuple[str, int]]:
        """Words within ``most`` edits; only the cells of a row that can stay within are kept."""
        out: list[tuple[str, int]] = []
        n, far = len(word), most + 1
        # the cells of a row at depth d stand for the first d - most .. d + most letters of the word
        stack = [(self.root, 0, [far] * most + [min(j, far) for j in range(most + 1)])]
        while stack:
            node, depth, row = stack.pop()
            if "" in node and 0 <= n - depth + most < len(row) and row[n - depth + most] <= most:
                out.append((node[""], row[n - depth + most]))
            for ch, child in node.items():
                if ch:
                    new, left = [], far
                    for k in range(2 * most + 1):
                        j = depth + 1 - most + k
                        if j < 0 or j > n:
                            left = far
                        else:
                            left = min(left + 1, (row[k + 1] if k < 2 * most else far) + 1, row[k] + (j == 0 or word[j - 1] != ch) if j else depth + 1, far)
                        new.append(left)
                    if min(new) <= most:
                        stack.append((child, depth + 1, new))
        return out


def edits(a: str, b: str) -> int:
    """Edit distance in which two neighbours swapped are one edit."""
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            d = min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y))
            if i and j and x == b[j - 1] and a[i - 1] == y:
                d = min(d, before[j - 1] + 1)
            new.append(d)
        before, row = row, new
    return row[-1]


def fold(text: str) -> str:
    """Small letters without accents, look-alikes mapped; digits read for letters become letters."""
    text = unicodedata.normalize("NFKC", HIDDEN.sub("", text))
    text = unicodedata.normalize("NFD", text.translate(SEEN))
    text = "".join(ch for ch in text if not unicodedata.combining(ch))
    return text.replace("ß", "ss").replace("ł", "l").replace("Ł", "L").replace("ø", "o").replace("Ø", "O").replace("æ", "ae").replace("ı", "i")


CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
DIGITS = str.maketrans("01358|", "olesbl")
TOKEN = re.compile(r"[^\W_]+(?:[-‐‑][^\W_]+)*")


def parts(name: str) -> list[list[tuple[str, bool, bool]]]:
    """Pieces between commas and brackets, each as tokens with: a full stop follows, all capitals."""
    text = CAMEL.sub(" ", fold(name)).replace("'", "").replace("’", "")
    text = re.sub(r"\b[Pp][Hh]\.\s*[Dd]\.?", " ", text)
    text = re.sub(r"\be\.\s*V\.", " ", text)
    out = []
    for piece in re.split(r"[,;()\[\]]", text):
        tokens = []
        short = len(TOKEN.findall(piece)) == 2  # a surname and capitals, which are initials even if they read like a title
        for m in TOKEN.finditer(piece):
            t = re.sub(r"[-‐‑]", "", m[0])  # a compound is one token
            if any(c.isalpha() for c in t) or len(t) > 2:
                t = t.translate(DIGITS)
                dot = piece[m.end() : m.end() + 1] == "."
                if t.lower() not in AROUND or (t == "The" and dot) or (short and tokens and t.isupper() and len(t) <= 3 and not dot):
                    tokens.append((t.lower(), dot, t.isupper()))
        if tokens:
            out.append(tokens)
    return out


def is_organisation(pieces: list[list[tuple[str, bool, bool]]]) -> bool:
    return any(t in KINDS for p in pieces for t, _, _ in p)


def comma_given(name: str | None) -> tuple[str, str] | None:
    """Given name and surname of a person written with a comma."""
    if not name or "," not in name:
        return None
    p = parts(name)
    if len(p) < 2 or is_organisation(p):
        return None
    given = p[1][0][0]
    return (given, "".join(t for t, _, _ in p[0])) if len(given) > 2 and len(p[0]) <= 2 else None


class Reader:
    """Reads names with what was learned of given names; small and picklable."""

    def __init__(self, given: set[str]):
        self.given = given | set(NICKNAMES) | {x for v in NICKNAMES.values() for x in v.split()}
        self.trie = Trie(sorted(g for g in self.given if len(g) >= 4))
        self.kinds = Trie(sorted(k for k in KINDS if len(k) > 5))
        self.seen: dict[str, bool] = {}

    def is_given(self, token: str) -> bool:
        hit = self.seen.get(token)
        if hit is None:
            most = 2 if len(token) > 6 else 1
            hit = token in self.given or (5 <= len(token) <= 12 and any(edits(token, g) <= most for g, _ in self.trie.near(token, 2)))
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[token] = hit
        return hit

    def read(self, name: str | None) -> tuple[str, str, str, bool] | None:
        """Key, given name or ``~`` for an organisation, initials, whether the given name is cut short."""
        if name is None:
            return None
        p = parts(name)
        flat = [x for piece in p for x in piece]
        if not flat or " ".join(t for t, _, _ in flat) in NOBODY:
            return None
        words = [t for t, _, _ in flat]
        if len(words) > 2 and (is_organisation(p) or any(w in LINKS for w in words) or any(self.kinds.near(w, 2) for w in words if len(w) > 5)):
            return self._organisation(p)
        if len(p) > 1:
            own, rest = p[0], [x for piece in p[1:] for x in piece]
        else:
            tokens = p[0]
            last = tokens[-1]
            if len(tokens) > 1 and len(last[0]) <= 3 and last[2] and not last[1] and not tokens[0][2] and len(tokens[0][0]) > 3:
                own, rest = tokens[:-1], [(ch, True, True) for ch in last[0]]
            elif len(tokens) == 2 and len(tokens[0][0]) == 2 and len(last[0]) <= 2 and last[2] and not tokens[0][2]:
                own, rest = tokens[:1], [(ch, True, True) for ch in last[0]]
            else:
                named = [len(t) <= 2 or self.is_given(t) or (dot and len(t) <= 4) for t, dot, _ in tokens]
                if all(named):
                    k = next((i for i, (t, _, _) in reversed(list(enumerate(tokens))) if t not in self.given), len(tokens) - 1)
                    named[k] = False
                elif len(tokens) > 1 and not any(named):
                    named[0] = len(tokens[0][0]) <= len(tokens[1][0])
                    if not named[0]:
                        named[-1] = len(tokens) > 1
                own = [x for x, g in zip(tokens, named) if not g]
                rest = [x for x, g in zip(tokens, named) if g]
        key = "".join(t for t, _, _ in own)
        if not key:
            return None
        rest = [(t[0], True, True) if len(t) == 1 else (t, dot, caps) for t, dot, caps in rest]
        spread = []
        for t, dot, caps in rest:
            spread += [(ch, True, True) for ch in t] if len(t) <= 2 and t not in self.given and (caps or dot) else [(t, dot, caps)]
        full = next(((t, dot) for t, dot, _ in spread[:1] if len(t) > 1), None)
        return key, full[0] if full else "", "".join(t[0] for t, _, _ in spread), bool(full and full[1] and len(full[0]) <= 4)

    def orders(self, name: str | None) -> list[tuple[str, str, str, bool]]:
        """The readings of a person's name that take another token for the surname."""
        first = self.read(name)
        p = parts(name) if first and first[1] != "~" else []
        tokens = [x for piece in p for x in piece]
        out = []
        if 2 <= len(tokens) <= 5:
            for k, (t, dot, _) in enumerate(tokens):
                if len(t) > 2 and not dot and t != first[0]:
                    rest = [x for i, x in enumerate(tokens) if i != k]
                    g, short, _ = next((x for x in rest if len(x[0]) > 1), ("", False, False))
                    out.append((t, g, "".join(x[0][0] for x in rest), bool(short and len(g) <= 4)))
        return out

    def _organisation(self, p: list[list[tuple[str, bool, bool]]]) -> tuple[str, str, str, bool] | None:
        rows = [[t for t, _, _ in piece] for piece in p]
        kind = next(((i, j) for i, r in enumerate(rows) for j, t in enumerate(r) if t in KINDS), None) or next(((i, j) for i, r in enumerate(rows) for j, t in enumerate(r) if len(t) > 5 and self.kinds.near(t, 2)), None)
        if kind is None:
            return None
        i, j = kind
        row = rows[i]
        if len(rows) > 1:
            proper, subject = "".join(rows[1 if i == 0 else 0]), row[j + 1 :]
        elif j:
            proper, subject = "".join(row[:j]), row[j + 1 :]
        elif "at" in row:
            k = len(row) - 1 - row[::-1].index("at")
            proper, subject = "".join(row[k + 1 :]), row[j + 1 : k]
        else:
            proper, subject = row[-1], row[j + 1 : -1]
        initials = row[j][0] + "".join(t[0] for t in subject if t not in LINKS)
        return (proper, "~", initials, False) if proper else None


def same_given(a: str, b: str) -> bool:
    if a == b or b in NICKNAMES.get(a, "").split() or a in NICKNAMES.get(b, "").split():
        return True
    if len(a) > 3 and len(b) > 3 and (a.startswith(b) or b.startswith(a)):
        return True
    d = edits(a, b)
    most = 2 if min(len(a), len(b)) >= 5 and a[0] == b[0] else 1
    if d <= most and min(len(a), len(b)) >= 3:
        return True
    # a nickname spelled wrongly, or a nickname of a name spelled wrongly
    return any(edits(x, y) <= 1 for x in NICKNAMES.get(a, "").split() for y in [b] if len(y) > 4) or any(edits(x, a) <= 1 for x in NICKNAMES.get(b, "").split() if len(a) > 4)


def _cuts(n: int) -> list[tuple[int, int]]:
    at = [n * i // PARTS for i in range(PARTS + 1)]
    return list(zip(at, at[1:]))


def _shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each key the shards that store it and those that it looks up.

    With ``EDITS`` edits one part stays whole. Part i of a stored key that is d
    letters shorter begins, in the key that looks up, at most i letters off
    from the front and at most ``EDITS - i`` off from the back.
    """
    for b in batches:
        rows = []
        for w in b["key"]:
            for i, (s, e) in enumerate(_cuts(len(w))):
                rows.append((f"{len(w)}/{i}/{w[s:e]}", w, True))
            for d in range(min(EDITS, len(w) - 1) + 1):
                n = len(w) - d
                for i, (s, e) in enumerate(_cuts(n)):
                    for at in range(max(0, s - i, s + d - (EDITS - i)), min(len(w) - (e - s), s + i, s + d + EDITS - i) + 1):
                        rows.append((f"{n}/{i}/{w[at : at + e - s]}", w, False))
        yield pd.DataFrame(rows, columns=["shard", "key", "stored"]).drop_duplicates()


def _walk(least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Pairs within the bound of each shard, which comes in consecutive rows, stored keys first."""
        shard, stored, trie, out = None, [], None, []
        for b in batches:
            for s, w, is_stored in zip(b["shard"], b["key"], b["stored"]):
                if s != shard:
                    shard, stored, trie = s, [], None
                if is_stored:
                    stored.append(w)
                elif stored:
                    trie = trie or Trie(stored)
                    out += [(w, x) for x, _ in trie.near(w, EDITS if len(w) > least else 1) if x != w]
            yield pd.DataFrame(out, columns=["a", "b"]).drop_duplicates()
            out = []

    return run


def _small(df: DataFrame) -> DataFrame:
    """``df``, which is cut, to be broadcast if it has at most ``BROADCAST`` rows."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


def near_keys(keys: DataFrame, least: int = 6, bound: int = SHARD) -> DataFrame:
    """``a, b``: pairs of keys within two edits (one if the longer has up to ``least`` letters), by trie join.

    Keys of one or two letters are near none: an edit would make any of them
    another name. Each task has pieces of shards of about ``bound`` stored keys
    and as many that look up, whatever part the keys share.
    """
    n = partitions(keys.sparkSession)
    x = keys.select("key").where(F.length("key") > 2).distinct().repartition(n).mapInPandas(_shards, "shard string, key string, stored boolean")
    x = cut(x)
    size = x.groupBy("shard").agg(F.count_if("stored").alias("_s"), F.count_if(~F.col("stored")).alias("_p"))
    pieces = lambda c: F.ceil(F.col(c) / bound).cast("int")
    hot = cut(size.where((F.col("_s") > bound) | (F.col("_p") > bound)).select("shard", pieces("_s").alias("_s"), pieces("_p").alias("_p")))
    x = x.join(_small(hot), "shard", "left").withColumn("_s", F.coalesce("_s", F.lit(1))).withColumn("_p", F.coalesce("_p", F.lit(1)))
    own = F.pmod(F.xxhash64("key"), F.when(F.col("stored"), F.col("_s")).otherwise(F.col("_p")))
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("stored"), F.col("_p")).otherwise(F.col("_s")) - 1))
    x = x.select("shard", "key", "stored", own.alias("_own"), other.alias("_other"))
    piece = F.when(F.col("stored"), F.concat_ws("/", "_own", "_other")).otherwise(F.concat_ws("/", "_other", "_own"))
    x = x.select(F.concat_ws("/", "shard", piece).alias("shard"), "key", "stored")
    x = x.repartition(n, "shard").sortWithinPartitions("shard", F.desc("stored"))
    return x.mapInPandas(_walk(least), "a string, b string").distinct()


def leaders(keys: DataFrame) -> DataFrame:
    """``key, lead``: where the walk from each key to the most frequent key near it that is more frequent than itself ends."""
    return follow(keys.select("key", "n"), near_keys(keys.select("key")))


def follow(keys: DataFrame, near: DataFrame) -> DataFrame:
    """``key, lead`` for ``key, n`` and pairs ``a, b`` in either order; the walks are halved until they end."""
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    up = both.join(keys.select(F.col("key").alias("a"), F.col("n").alias("na")), "a").join(keys.select(F.col("key").alias("b"), F.col("n").alias("nb")), "b")
    up = up.where(F.struct("nb", "b") > F.struct("na", "a")).groupBy("a").agg(F.max(F.struct("nb", "b"))["b"].alias("lead")).withColumnRenamed("a", "key")
    now = cut(keys.select("key").join(up, "key", "left").select("key", F.coalesce("lead", "key").alias("lead")))
    while True:
        above = now.select(F.col("key").alias("lead"), F.col("lead").alias("_top"))
        new = cut(now.join(above, "lead").select("key", F.col("_top").alias("lead"), (F.col("_top") != F.col("lead")).alias("_moved")))
        now = new.select("key", "lead")
        if new.where("_moved").isEmpty():
            return now


def alike(given: DataFrame) -> DataFrame:
    """``a, b``: pairs of distinct given names (column ``key``) that may be one, in both orders; see ``same_given``."""
    spark = given.sparkSession
    nick = spark.createDataFrame([(a, x) for a, v in NICKNAMES.items() for x in v.split()], "a string, x string")
    words = given.unionByName(nick.select(F.col("x").alias("key"))).distinct()
    near = near_keys(words, 0)
    near = cut(near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    heads = given.select(F.col("key").alias("a"), F.explode(F.sequence(F.lit(4), F.greatest(F.lit(4), F.length("key")))).alias("_n")).where(F.length("a") > F.col("_n")).select("a", F.expr("left(a, _n)").alias("b"))
    starts = heads.join(given.select(F.col("key").alias("b")), "b").select("a", "b")
    # a nickname with its name, or with a name near that
    told = nick.select("a", F.col("x").alias("b")).unionByName(nick.join(near.select(F.col("a").alias("x"), "b"), "x").select("a", "b"))
    found = near.unionByName(starts).unionByName(told)
    found = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    inside = given.select(F.col("key").alias("a"))
    found = found.where("a <> b").join(inside, "a", "left_semi").join(inside.withColumnRenamed("a", "b"), "b", "left_semi").select("a", "b")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[[same_given(x, y) for x, y in zip(b["a"], b["b"])]]

    return found.mapInPandas(check, "a string, b string")


def heads_of(full: DataFrame, same: DataFrame) -> DataFrame:
    """``lead, given, head``: given names below a surname follow the first one like them that follows none itself.

    ``full`` has ``lead, given, n``; first comes what is no nickname, then the
    most frequent. Every round settles all names that have no open one before
    them and those like them.
    """
    rank = F.struct((~F.col("given").isin(sorted(NICKNAMES))).alias("p"), F.col("n").alias("n"), F.col("given").alias("g"))
    nodes = cut(full.select("lead", "given", rank.alias("rank")))
    other = nodes.select("lead", F.col("given").alias("b"), F.col("rank").alias("rank_b"))
    edges = cut(nodes.join(_small(cut(same)), F.col("given") == F.col("a")).join(other, ["lead", "b"]).where("rank_b > rank").select("lead", "given", "b", "rank_b"))
    open_, done = nodes.select("lead", "given"), []
    while True:
        top = open_.join(edges, ["lead", "given"], "left_anti")
        below = edges.join(top.select("lead", F.col("given").alias("b")), ["lead", "b"], "left_semi").groupBy("lead", "given").agg(F.max(F.struct("rank_b", "b"))["b"].alias("head"))
        level = cut(top.withColumn("head", F.col("given")).unionByName(below))
        done.append(level)
        open_ = cut(open_.join(level, ["lead", "given"], "left_anti"))
        if open_.isEmpty():
            break
        edges = cut(edges.join(open_, ["lead", "given"], "left_semi").join(open_.withColumnRenamed("given", "b"), ["lead", "b"], "left_semi").select("lead", "given", "b", "rank_b"))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def _one(rows: DataFrame, by: list[str]) -> DataFrame:
    """``by, head, many``: the one head of a group, or that there are several; added up before the shuffle."""
    g = rows.groupBy(*by).agg(F.min("head").alias("head"), F.max("head").alias("_top"))
    return g.select(*by, "head", (F.col("head") != F.col("_top")).alias("many"))


def _spelled_near(text: Column) -> Column:
    """What strings of one length share that differ in one letter: the string without it."""
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.concat(i.cast("string"), F.lit(":"), F.substring(text, F.lit(1), i - 1), F.lit("_"), F.substring(text, i + 1, F.length(text))))


def grouped(spelled: DataFrame) -> DataFrame:
    """``lead, given, initials, short, group`` for the distinct spellings ``lead, given, initials, short, n`` below each key."""
    what = ["lead", "given", "initials", "short"]
    spelled = cut(spelled)
    organised = spelled.where("given = '~'").select(*what, F.concat(F.lit("~"), "initials").alias("group"))
    full = spelled.where("given not in ('', '~') and not short")
    head = cut(heads_of(full.groupBy("lead", "given").agg(F.sum("n").alias("n")), alike(full.select(F.col("given").alias("key")).distinct())))
    named = full.join(head, ["lead", "given"]).select(*what, F.col("head").alias("group"))
    # the letters that stand for a head: its own and, for a nickname, those of its names
    letters = F.create_map(*[F.lit(x) for a, v in NICKNAMES.items() for x in (a, "".join(sorted({w[0] for w in v.split()})))])
    own = full.join(head, ["lead", "given"]).select("lead", "head", F.substring("initials", 2, 1).alias("middle")).distinct()
    own = own.withColumn("letter", F.explode(F.array_distinct(F.split(F.concat(F.substring("head", 1, 1), F.coalesce(F.try_element_at(letters, F.col("head")), F.lit(""))), ""))))
    by_letter, by_middle = _one(own, ["lead", "letter"]), _one(own.where("middle <> ''"), ["lead", "letter", "middle"])
    only = spelled.where("given = ''").withColumn("letter", F.substring("initials", 1, 1)).withColumn("middle", F.substring("initials", 2, 1))
    group = organised.select("lead", "initials", F.lit(True).alias("is_group")).distinct().where(F.length("initials") > 1)
    only = only.join(group, ["lead", "initials"], "left").join(by_letter, ["lead", "letter"], "left").join(by_middle.select("lead", "letter", "middle", F.col("head").alias("head2"), F.col("many").alias("many2")), ["lead", "letter", "middle"], "left")
    chosen = F.when(F.col("is_group"), F.concat(F.lit("~"), "initials")).when(~F.col("many"), F.col("head")).when(~F.col("many2"), F.col("head2")).otherwise(F.concat(F.lit("."), "letter"))
    only = only.select(*what, chosen.alias("group"))
    # abbreviations with a full stop: the one head that begins so, or else the one that does but for a letter
    cut_short = spelled.where("given not in ('', '~') and short")
    begin = head.select("lead", "head").distinct().withColumn("_n", F.explode(F.sequence(F.lit(2), F.lit(4)))).where(F.length("head") >= F.col("_n")).withColumn("given", F.expr("left(head, _n)"))
    exact = _one(begin.select("lead", "given", "head"), ["lead", "given"])
    swaps = F.transform(F.sequence(F.lit(1), F.length("given") - 1), lambda i: F.concat(F.lit("="), F.substring(F.col("given"), F.lit(1), i - 1), F.substring(F.col("given"), i + 1, F.lit(1)), F.substring(F.col("given"), i, F.lit(1)), F.substring(F.col("given"), i + 2, F.lit(4))))
    masks = begin.where("_n >= 3").select("lead", "head", F.explode(F.concat(_spelled_near(F.col("given")), swaps)).alias("mask"))
    asked = cut_short.where(F.length("given") >= 3).select(*what, F.explode(F.concat(_spelled_near(F.col("given")), F.array(F.concat(F.lit("="), "given")))).alias("mask"))
    wrong = _one(asked.join(masks, ["lead", "mask"]), what).select(*what, F.col("head").alias("head2"), F.col("many").alias("many2"))
    short = cut_short.join(exact, ["lead", "given"], "left").join(wrong, what, "left")
    none = F.concat(F.lit("."), F.substring("given", 1, 1))
    short = short.select(*what, F.when(F.col("many").isNull() & ~F.col("many2"), F.col("head2")).when(~F.col("many"), F.col("head")).otherwise(none).alias("group"))
    return organised.unionByName(named).unionByName(only).unionByName(short)


def entities(df: DataFrame, key: str, name: str) -> DataFrame:
    """``key, name, entity``: the entity of each distinct row; names that name nobody, null and blank ones are left out."""
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    rows = df.where(F.col(name).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(name).alias("name")).distinct()
    distinct = cut(rows.groupBy("name").agg(F.count("*").alias("n")))

    def comma(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([x for x in map(comma_given, b["name"]) if x], columns=["given", "key"])

    learned = cut(distinct.select("name").mapInPandas(comma, "given string, key string").groupBy("given").agg(F.countDistinct("key").alias("n")))
    total = learned.agg(F.sum("n")).first()[0] or 0
    given = {r[0] for r in learned.where(F.col("n") >= max(2, GIVEN_SHARE * total)).select("given").toLocalIterator()}
    shared = spark.sparkContext.broadcast(Reader(given))
    form = "name string, n long, key string, given string, initials string, short boolean, other boolean"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = shared.value
        for b in batches:
            got = [(x, n, *g, i > 0) for x, n in zip(b["name"], b["n"]) for i, g in enumerate([r.read(x), *r.orders(x)]) if g]
            yield pd.DataFrame(got, columns=["name", "n", "key", "given", "initials", "short", "other"])

    every = cut(distinct.repartition(partitions(spark)).mapInPandas(read, form))
    forms, others = every.where("not other").drop("other"), every.where("other").drop("other")
    near = cut(near_keys(every.select("key")))
    support = cut(forms.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("names")))
    # names alone with their key take the order whose key, or one near it, most names have
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    company = both.join(support.select(F.col("key").alias("b")), "b").select(F.col("a").alias("key")).distinct()
    alone = support.where("names = 1").select("key").join(company, "key", "left_anti")
    lonely = forms.join(alone, "key", "left_semi").select("name")
    tried = others.join(lonely, "name", "left_semi")
    reach = both.select(F.col("a").alias("key"), "b").unionByName(tried.select("key", F.col("key").alias("b")).distinct())
    seen = tried.join(reach, "key").join(support.select(F.col("key").alias("b"), F.col("n").alias("nb")), "b")
    turned = seen.groupBy("name").agg(F.max(F.struct("nb", "b", "n", "key", "given", "initials", "short")).alias("m")).select("name", "m.n", "m.key", "m.given", "m.initials", "m.short")
    turned = cut(turned)
    forms = cut(forms.join(turned, "name", "left_anti").unionByName(turned))
    keys = cut(forms.groupBy("key").agg(F.sum("n").alias("n")))
    lead = follow(keys, near)
    under = forms.join(lead, "key")
    made = grouped(under.groupBy("lead", "given", "initials", "short").agg(F.sum("n").alias("n")))
    named = under.join(made, ["lead", "given", "initials", "short"]).select("name", F.concat_ws("/", "lead", "group").alias("entity"))
    return rows.join(named, "name").select(F.col("id").cast(kind).alias(key), "name", "entity")


def pairs(df: DataFrame, key: str, name: str) -> DataFrame:
    """``id_a, id_b``: rows whose names are stored differently and mean the same, ``id_a < id_b``."""
    e = cut(entities(df, key, name).select("entity", F.col(key).alias("id"), F.xxhash64("name").alias("h")))
    a = e.select("entity", F.col("id").alias("id_a"), F.col("h").alias("ha"))
    b = e.select("entity", F.col("id").alias("id_b"), F.col("h").alias("hb"))
    return a.join(b, "entity").where("id_a < id_b and ha <> hb").select("id_a", "id_b").distinct()
