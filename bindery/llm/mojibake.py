"""Problem 4: text garbled by a wrong character encoding.

A noisy channel. The source is a model of the corpus: frequencies of its words
with letters outside ASCII, and of pairs of characters for words it doesn't
know. The channel is a pair of encodings (written in, read in) or U+FFFD for
lost bytes. Each word has, for each channel, the reading that the bytes give;
a lost byte is a wildcard in the lattice of possible bytes. A Viterbi search
over the words of a text, with the channel as its state, weighs what the
readings gain against the price of entering a channel; a text whose best path
leaves the state "as it is" is garbled, and the path gives its restoration.

The word counts are made over all rows in the JVM. Words rarer than
``MIN_SHARE`` of all counted words are left to the character model, so at most
``1 / MIN_SHARE`` words are collected and broadcast, however large the corpus.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import cache, lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.llm.lookalike import LOOKS
from bindery.session import written

MIN_SHARE = 2e-6
MIN_COUNT = 3
ENTER = 4.0
ENTER_UTF8 = 2.0
LOSS = 2.0  # price of a lost byte that no channel explains
DOUBT = 16.0  # what an ordinary-looking word must gain by a reading that is no word of the corpus
LOST = "�"
EDGE = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))

# Encodings in which text is written and, for each, those in which it is mistakenly read.
CHANNELS = {
    "utf-8": ["cp1252", "latin-1", "mac-roman", "cp437", "cp850", "cp1251", "cp866", "koi8-r", "iso8859-15", "cp1250", "mac-cyrillic"],
    "cp1252": ["mac-roman", "cp437", "cp850", "cp1251", "cp866", "koi8-r", "cp1250"],
    "mac-roman": ["cp1252", "latin-1", "cp437"],
    "cp1251": ["cp1252", "latin-1", "koi8-r", "cp866", "mac-roman", "mac-cyrillic", "cp437"],
    "koi8-r": ["cp1251", "cp866", "cp1252", "latin-1", "mac-roman"],
    "cp866": ["cp1251", "koi8-r", "cp1252", "latin-1", "cp437", "mac-roman"],
    "cp437": ["cp1252", "latin-1", "mac-roman"],
    "cp850": ["cp1252", "latin-1", "mac-roman"],
}


@cache
def _bytes_of(codec: str) -> dict[str, int]:
    """Character to byte; bytes without a character stand for the control character of their number, as browsers do."""
    out = {}
    for n in range(128, 256):
        try:
            out[bytes([n]).decode(codec)] = n
        except UnicodeDecodeError:
            out[chr(n)] = n
    return out


@cache
def _chars_of(codec: str) -> dict[int, str]:
    return {n: ch for ch, n in _bytes_of(codec).items()}


@cache
def _holes(codec: str) -> tuple[int, ...]:
    """Bytes without a character: those that a strict reader loses."""
    out = []
    for n in range(128, 256):
        try:
            bytes([n]).decode(codec)
        except UnicodeDecodeError:
            out.append(n)
    return tuple(out)


RUN = re.compile(r"[^\x00-\x7f]+")
NON_ASCII = re.compile(r"[^\x00-\x7f]")


# blanks and characters without a shape, which alone are no sign of a wrong encoding
QUIET = re.compile("[\xa0\xad\u034f\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufe00-\ufe0f\ufeff]+")


# A lattice has for each position of a run its edges: the position after and what may stand between.
Lattice = list[list[tuple[int, str]]]


def _bytes_lattice(sets: list[tuple[int, ...]]) -> list[list[tuple[int, int]]]:
    return [[(i + 1, b) for b in x] for i, x in enumerate(sets)]


def _utf8_lattice(edges: list[list[tuple[int, int]]]) -> Lattice:
    """The characters that a lattice of bytes may hold in UTF-8: those of each position only, never whole strings."""
    size = len(edges)
    out: Lattice = []
    for here in edges:
        made = []
        for q, first in here:
            n = 2 if 0xC2 <= first <= 0xDF else 3 if 0xE0 <= first <= 0xEF else 4 if 0xF0 <= first <= 0xF4 else 0
            heads = [(q, bytes([first]))] if n else []
            for _ in range(n - 1):
                heads = [(r, h + bytes([b])) for at, h in heads if at < size for r, b in edges[at] if 0x80 <= b <= 0xBF]
            for at, h in heads:
                try:
                    made.append((at, h.decode()))
                except UnicodeDecodeError:
                    continue
        out.append(made)
    return out


def _again(lattice: Lattice, read: str) -> Lattice:
    """A lattice whose characters are once more bytes of UTF-8 read in ``read``."""
    table = _bytes_of(read)
    return _utf8_lattice([[(q, table[ch]) for q, ch in here if ch in table] for here in lattice])


def _ends(lattice: Lattice) -> bool:
    """Whether a path leads through."""
    open_ = {0}
    for i, here in enumerate(lattice):
        if i in open_:
            open_ |= {q for q, _ in here}
    return len(lattice) in open_


def _as_utf8(run: str, read: str) -> str | None:
    """The reading of a run whose characters are UTF-8 bytes read in ``read``; None if they aren't."""
    table = _bytes_of(read)
    try:
        return bytes([table[ch] for ch in run]).decode()
    except (KeyError, UnicodeDecodeError):
        return None


def _damaged(run: str, written: str, read: str) -> Lattice | None:
    """The lattice of a run with lost characters, each of which may be any byte that ``read`` lacks; None if none leads through."""
    table, holes = _bytes_of(read), _holes(read)
    sets = [holes if ch == LOST else (table[ch],) if ch in table else () for ch in run]
    if not all(sets):
        return None
    if written == "utf-8":
        lattice = _utf8_lattice(_bytes_lattice(sets))
    else:
        chars = _chars_of(written)
        lattice = [[(i + 1, chars[n]) for n in x if chars[n] >= "\xa0"] for i, x in enumerate(sets)]
    return lattice if _ends(lattice) else None


@cache
def _codes() -> tuple[dict[str, dict[str, int]], dict[str, list[str]], dict[str, frozenset[int]], frozenset[str]]:
    """Characters to bytes by encoding read in; bytes to characters and bytes that aren't visible by encoding written in; all characters that are bytes of any."""
    reads = {r: _bytes_of(r) for rs in CHANNELS.values() for r in rs}
    chars = {w: [_chars_of(w).get(n, chr(n)) for n in range(256)] for w in CHANNELS if w != "utf-8"}
    bad = {w: frozenset(n for n in range(128, 256) if c[n] < "\xa0") for w, c in chars.items()}
    return reads, chars, bad, frozenset(ch for t in reads.values() for ch in t)


@lru_cache(100_000)
def _of_run(run: str) -> dict[tuple[str, str], str]:
    """Readings of a run of whole characters outside ASCII, for each channel that has one; words share few runs."""
    if QUIET.fullmatch(run):
        return {(w, r): run for w, rs in CHANNELS.items() for r in rs}
    reads, chars, bad, _ = _codes()
    need = set(run)
    raws = {r: bytes([t[ch] for ch in run]) for r, t in reads.items() if t.keys() >= need}
    out = {}
    for written, channel_reads in CHANNELS.items():
        for read in channel_reads:
            raw = raws.get(read)
            if raw is None:
                continue
            if written != "utf-8":
                if bad[written].isdisjoint(raw):
                    out[written, read] = "".join([chars[written][n] for n in raw])
            elif 0xC2 <= raw[0] <= 0xF4:
                try:
                    out[written, read] = raw.decode()
                except UnicodeDecodeError:
                    continue
    return out


def _no_bytes(token: str) -> bool:
    """Whether no channel can have led to a word: a run has characters of no encoding, or all are without a shape."""
    known = _codes()[3]
    loud = [r for r in RUN.findall(token) if not QUIET.fullmatch(r)]
    return LOST not in token and (not loud or not all(known.issuperset(r) for r in loud))


@lru_cache(20_000)
def _of_damaged(run: str) -> dict[tuple[str, str], Lattice]:
    """The same for a run with lost characters, as lattices."""
    out = {}
    for written, reads in CHANNELS.items():
        for read in reads:
            found = _damaged(run, written, read)
            if found is not None:
                out[written, read] = found
    return out


@lru_cache(100_000)
def _choices(run: str) -> frozenset[str] | None:
    """All that a run may have been by encodings of one byte; None if it may be UTF-8."""
    found = _of_run(run)
    return None if any(c[0] == "utf-8" for c in found) else frozenset(found.values())


class Pairs(dict):
    """Scores of pairs of characters; those of pairs not counted are made when first asked for."""

    def __init__(self, known: dict[str, float], single: dict[str, float], unseen: float):
        super().__init__(known)
        self.single, self.unseen = single, unseen

    def __missing__(self, pair: str) -> float:
        x = self.single.get(pair[1])
        s = math.log(x) if x else self.unseen
        if len(self) < 1_000_000:
            self[pair] = s
        return s

    def __reduce__(self):
        return Pairs, (dict(self), self.single, self.unseen)


class Model:
    """Word and character frequencies of the corpus and the scores built on them; picklable and of bounded size."""

    def __init__(self, counts: dict[str, float], scale: float = 1.0):
        counts = {w: n * scale for w, n in counts.items()}
        total = sum(counts.values()) + 1
        self.words = {w: math.log(n / total) for w, n in counts.items()}
        pairs, firsts, single = Counter(), Counter(), Counter()
        for w, n in counts.items():
            w = f" {w} "
            for a, b in zip(w, w[1:]):
                pairs[a + b] += n
                firsts[a] += n
                single[b] += n
        whole = sum(single.values()) + 1
        self.single = {ch: 0.05 * n / whole for ch, n in single.items()}
        self.unseen = math.log(1e-8)
        self.pairs = Pairs({p: math.log(0.95 * n / firsts[p[0]] + self.single[p[1]]) for p, n in pairs.items()}, self.single, self.unseen)
        self.unknown = math.log(0.05)
        self.sorted = sorted(w for w in counts if LOST not in w)
        good = Counter()
        for ch, n in single.items():
            if ch > "\x7f" and ch != LOST and ch.isalpha():
                good[ch] = n
        self.letters = [ch for ch, n in good.most_common() if n > 2e-4 * sum(good.values())]
        self.cache: dict[str, tuple] = {}

    def cleaned(self) -> Model:
        """The model without the garbled words of the corpus: those that gain by a reading under the first counts."""
        total = max(1, len(self.words))
        kept = {w: math.exp(p) for w, p in self.words.items() if LOST not in w and not self.gains(w, known=True)[1]}
        return Model(kept, scale=1 / min(kept.values())) if kept and total else self

    def chars(self, text: str, run: str = "") -> float:
        """Of all pairs of characters in a word, or of those at its one ``run``."""
        pairs, text = self.pairs, f" {text} "
        if run:
            at = text.index(run) - 1
            text = text[at : at + len(run) + 2]
        return sum([pairs[a + b] for a, b in zip(text, text[1:])])

    def score(self, token: str) -> float:
        core = token.strip(EDGE)
        s = self.words.get(core)
        if s is not None:
            return s
        small = core.lower()
        if len(core) > 2 and (core.isupper() or core[1:].islower()):  # a word that usually has small letters
            s = self.words.get(small)
            if s is not None:
                return s - 1
        s = self.chars(core)
        return self.unknown + (max(s, self.chars(small) - 2) if core.isupper() else s)

    def readings(self, token: str) -> dict[tuple[str, str], list[str]]:
        """The readings of a word by channel; UTF-8 read wrongly more than once is read back up to three times."""
        runs = RUN.findall(token)
        if LOST in token:
            return self._damaged_readings(token, runs)
        out = {}
        of_run = [_of_run(r) for r in runs]
        for channel in of_run[0] if of_run else [(w, r) for w, reads in CHANNELS.items() for r in reads]:
            if all(channel in f for f in of_run[1:]):
                made = iter([f[channel] for f in of_run])
                out[channel] = [RUN.sub(lambda m, made=made: next(made), token)]
        for _ in range(2):
            for read in CHANNELS["utf-8"][:3]:
                if ("utf-8", read) in out:
                    again = []
                    for x in out["utf-8", read]:
                        for more in CHANNELS["utf-8"][:3]:
                            found = [r if QUIET.fullmatch(r) else _as_utf8(r, more) for r in RUN.findall(x)]
                            if found and None not in found:
                                made = iter(found)
                                again.append(RUN.sub(lambda m, made=made: next(made), x))
                    out["utf-8", read] += [a for a in again if a not in out["utf-8", read]]
        return out

    def _damaged_readings(self, token: str, runs: list[str]) -> dict[tuple[str, str], list[str]]:
        """The best readings of a word with lost bytes through each channel's lattice, and with any letters in their place."""
        core = token.strip(EDGE)
        i = token.index(core)
        before, after = token[:i], token[i + len(core) :]
        parts = re.split(f"({RUN.pattern})", core)
        out = {}
        of_run = [_of_damaged(r) if LOST in r else _of_run(r) for r in parts[1::2]]
        for channel in {c for f in of_run for c in f}:
            if all(channel in f for f in of_run):
                levels = [[f[channel] if LOST in r else [[(1, f[channel])]] for r, f in zip(parts[1::2], of_run)]]
                if channel[0] == "utf-8" and channel[1] in CHANNELS["utf-8"][:3]:
                    for more in CHANNELS["utf-8"][:3]:
                        twice = [_again(x if LOST in r else [[(j + 1, ch)] for j, ch in enumerate(x[0][0][1])], more) for r, x in zip(parts[1::2], levels[0])]
                        if all(_ends(x) for x in twice):
                            levels.append(twice)
                out[channel] = [before + x + after for lattices in levels for x in self.best(parts[::2], lattices)]
        anything = [[[(j + 1, o) for o in (self.letters if ch == LOST else (ch,))] for j, ch in enumerate(r)] for r in parts[1::2]]
        out["lost", ""] = [before + x + after for x in self.best(parts[::2], anything)]
        return {c: x for c, x in out.items() if x}

    def best(self, plain: list[str], lattices: list[Lattice]) -> list[str]:
        """The likeliest ways through a word's lattices by its pairs of characters and by the corpus words that fit; at most three.

        Viterbi: for each position and last character only the best way is
        kept, as a pointer back, so the work grows with the length of the word
        and not with the number of strings. Corpus words are followed as ranges
        of the sorted list of words.
        """
        edges: Lattice = []
        for i, text in enumerate(plain):
            for ch in text:
                edges.append([(len(edges) + 1, ch)])
            if i < len(lattices):
                base = len(edges)
                edges += [[(base + q, x) for q, x in here] for here in lattices[i]]
        found = [x for small in (False, True) if (x := self._by_pairs(edges, small))]
        if word := self._by_words(edges):
            found.append(word)
        return sorted(set(found))

    def _by_pairs(self, edges: Lattice, small: bool) -> str | None:
        pairs = self.pairs
        at: list[dict[str, tuple]] = [{} for _ in range(len(edges) + 1)]
        at[0][" "] = (0.0, -1, "", "")
        for i, here in enumerate(edges):
            for q, text in here:
                for last, (score, _, _, _) in at[i].items():
                    p, s = last, score
                    for ch in text.lower() if small else text:
                        s += pairs[p + ch]
                        p = ch
                    old = at[q].get(p)
                    if old is None or s > old[0]:
                        at[q][p] = (s, i, last, text)
        if not at[-1]:
            return None
        last = max(at[-1], key=lambda ch: (at[-1][ch][0] + pairs[ch + " "], ch))
        out, i = [], len(edges)
        while i > 0:
            _, before, p, text = at[i][last]
            out.append(text)
            i, last = before, p
        return "".join(reversed(out))

    def _by_words(self, edges: Lattice) -> str | None:
        """The most frequent corpus word that the lattice holds."""
        words = self.sorted
        at: list[set[tuple[str, int, int]]] = [set() for _ in range(len(edges) + 1)]
        at[0].add(("", 0, len(words)))
        for i, here in enumerate(edges):
            for prefix, lo, hi in at[i]:
                for q, text in here:
                    longer = prefix + text
                    a = bisect_left(words, longer, lo, hi)
                    if a < hi and words[a].startswith(longer):
                        at[q].add((longer, a, bisect_left(words, longer + "\U0010ffff", a, hi)))
        whole = [w for w, _, _ in at[-1] if w in self.words]
        return max(whole, key=lambda w: (self.words[w], w)) if whole else None

    def knows(self, token: str) -> bool:
        core = token.strip(EDGE)
        return core in self.words or ((core.isupper() or core[1:].islower()) and core.lower() in self.words)

    def price(self, plain: str, reading: str) -> float:
        """What a reading must gain over an ordinary-looking word, seen as ``plain``, to show that it is garbled."""
        core = reading.strip(EDGE)
        if (plain.isascii() and len(plain.strip(EDGE)) == 1) or BOXES.search(core):
            return math.inf
        return ENTER if self.knows(core) else DOUBT

    def may_gain(self, token: str) -> bool:
        """False if no reading of an ordinary-looking word can reach its ``price``, which saves scoring them.

        A reading differs in the pairs at its run only, and none scores above
        0: one that is no word gains at most what these pairs cost now.
        """
        runs = RUN.findall(token)
        core = token.strip(EDGE)
        choices = _choices(runs[0]) if len(runs) == 1 and SMALL.search(core) else None
        if choices is None:
            return True
        i = token.index(runs[0])
        before, after = token[:i], token[i + len(runs[0]) :]
        if any(self.knows(before + o + after) for o in choices):
            return True
        return bool(choices) and -self.chars(core, runs[0]) > DOUBT

    def gains(self, token: str, every: bool = False, known: bool = False) -> tuple[dict[tuple[str, str], tuple[float, str]], bool]:
        """For each channel what its best reading gains over the word as it is; whether that shows a garbled word.

        Any gain does, for words that look ordinary one above ``price``. Those
        of them that the corpus knows have no readings, unless ``known`` asks
        for them to clean the corpus, or ``every``, as beside a garbled word.
        """
        kept = (token, every, known) if every or known else token
        hit = self.cache.get(kept)
        if hit is None and _no_bytes(token):
            hit = self.cache[kept] = ({}, False)
        if hit is None:
            plain = as_seen(token)
            usual = not every and ordinary(plain) and not LIGATURE.search(token)
            if usual and (not known and (self.knows(token) or self.knows(plain)) or not self.may_gain(token)):
                hit = ({}, False)
            else:
                own = max(self.score(x.replace(LOST, "\x00")) for x in {token, plain})  # no clean text holds a lost character
                read = self.readings(token)
                scores = {x: self.score(x) for x in {x for r in read.values() for x in r}}  # channels share many readings
                options = {c: max((scores[x], x) for x in r) for c, r in read.items()}
                found = {c: (s - own, x) for c, (s, x) in options.items()}
                for c in found:
                    if LOST in token:
                        g, x = found[c]
                        found[c] = (g - token.count(LOST) * (LOSS if c[0] == "lost" else 0), x)
                hit = (found, any(g > (self.price(plain, x) if usual else 0) for g, x in found.values()))
            if len(self.cache) > 300_000:
                self.cache.clear()
            self.cache[kept] = hit
        return hit

    def restore(self, text: str) -> str | None:
        """The restored text, or None if the text isn't garbled."""
        tokens = split(text)
        scored = [self.gains(t) for t in tokens]
        if not any(s for _, s in scored):
            return None
        scored = [self.gains(t, True) for t in tokens]
        same = ("", "")
        # for each word and channel the score of the best way there and the channel of the word before
        states, back = {same: 0.0}, []
        for found, _ in scored:
            top = max(states, key=states.__getitem__)
            new, came = {same: states[top]}, {same: top}
            for c, (g, _) in found.items():
                enter = states[top] - (ENTER_UTF8 if c[0] == "utf-8" else ENTER)
                stay = states.get(c, -math.inf)
                new[c], came[c] = (stay + g, c) if stay >= enter else (enter + g, top)
            states = new
            back.append(came)
        c = max(states, key=states.__getitem__)
        path = []
        for came in reversed(back):
            path.append(c)
            c = came[c]
        path.reverse()
        if all(c == same for c in path):
            return None
        out, at = [], 0
        for t, c, (found, _) in zip(tokens, path, scored):
            i = text.index(t, at)
            out += [text[at:i], t if c == same else found[c][1]]
            at = i + len(t)
        return "".join([*out, text[at:]])


BLANK = " \\t\\n\\r\\x00-\\x08\\u2000-\\u200a\\u202f\\u205f\\u3000"
# a non-breaking space belongs to a word only as the last byte of a character of UTF-8
IN_WORD = f"(?:[^{BLANK}\\xa0]|(?<=[ÂÃÐÑРСâГ├┬√¬╨╤])\\xa0)"
WORD = re.compile(f"{IN_WORD}*[^{BLANK}\\xa0\\x00-\\x7f]{IN_WORD}*")
# read in a code of a text screen, byte FF, which is a letter elsewhere, becomes a non-breaking space
SCREEN = re.compile("[\u2500-\u259f\u221a]|(?<=[\u0400-\u045f])[\xb0\u2219\u221a\u25a0\u2116\xa4](?=[\u0400-\u045f])")
WIDE = re.compile(f"[^{BLANK}]*[^{BLANK}\\xa0\\x00-\\x7f][^{BLANK}]*")
BLANKS = re.compile(f"[{BLANK}]+")


def split(text: str) -> list[str]:
    """The words of a text that hold a character outside ASCII."""
    if "\xa0" not in text:
        return [w for w in BLANKS.split(text) if not w.isascii()]
    return (WIDE if SCREEN.search(text) else WORD).findall(text)
LATIN = re.compile("[A-Za-z]")
LIGATURE = re.compile("[ﬀ-ﬆ]")
SMALL = re.compile("[a-z]")
BOXES = re.compile("[\u2300-\u25ff]")
SEEN = {ord(a): b for a, b in LOOKS.items() if a not in "Ёё"}


def as_seen(token: str) -> str:
    """A word without characters that have no shape, width forms and ligatures resolved; in words with Latin letters also look-alikes."""
    token = QUIET.sub("", token)
    token = "".join(unicodedata.normalize("NFKC", ch) if "ﬀ" <= ch <= "ﬆ" or "！" <= ch <= "～" or "Ⅰ" <= ch <= "ⅿ" else ch for ch in token)
    seen = token.translate(SEEN)
    if LATIN.search(token) or seen.isascii():
        token = seen
    return unicodedata.normalize("NFC", token)


# small Latin letters with accents standing alone among ASCII, or a word all in Cyrillic of usual case
ORDINARY = re.compile(r"(?:[\x21-\x7e]|(?<![^\x00-\x7f])[ß-öø-ÿ](?![^\x00-\x7f])|(?<![a-z])[ÀÉÜÖÄÑÎÊÇÁÓÚ](?![a-z]))+|[\x21-\x40]*[А-ЯЁ]?[а-яё]+[\x21-\x40]*")


def ordinary(token: str) -> bool:
    return ORDINARY.fullmatch(token) is not None


def _text(df: DataFrame, text: str) -> DataFrame:
    return df.where(F.col(text).isNotNull() & (F.octet_length(text) != F.length(text)))


def words(text: Column) -> Column:
    """The words of a text that hold a character outside ASCII, without ASCII punctuation at their ends."""
    some = F.filter(F.split(text, "[ \\t\\n\\r\\u00a0\\u2000-\\u200a\\u202f\\u205f\\u3000]+"), lambda w: F.octet_length(w) != F.length(w))
    return F.transform(some, lambda w: F.btrim(w, F.lit(EDGE)))


def model(df: DataFrame, text: str) -> Model:
    """The corpus model, counted over all rows of ``df``."""
    counts = _text(df, text).select(F.explode(words(F.col(text))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    with written(counts) as counts:
        total = counts.agg(F.sum("n")).first()[0] or 0
        kept = counts.where(F.col("n") >= max(MIN_COUNT, math.ceil(MIN_SHARE * total))).toPandas()
    first = Model(dict(zip(kept["w"], kept["n"])))
    return first.cleaned()


def restored(df: DataFrame, text: str, keys: list[str], source: Model) -> DataFrame:
    """``keys, text, restored`` of the garbled rows only.

    Null and empty texts are never garbled, repeated rows count once. A text
    with U+FFFD counts as garbled, for it lost bytes; what can't be had stays
    as it is in ``restored``.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(source)
    schema = df.select(*keys, text).schema
    names = [f"k{i}" for i in range(len(keys))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            made = [m.restore(t) for t in b["text"]]
            b = b.assign(restored=made)
            yield b[b["restored"].notna()]

    base = _text(df, text).select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(text).alias("text"))
    out = ", ".join([f"{n} {schema[k].dataType.simpleString()}" for k, n in zip(keys, names)] + ["text string", "restored string"])
    return base.mapInPandas(run, out).distinct().select(*[F.col(n).alias(k) for k, n in zip(keys, names)], "text", "restored")
