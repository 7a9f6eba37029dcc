"""Problem 7: evaluation texts inside a corpus.

Each part of a partition gets an FM-index over its words: a suffix array by
prefix doubling, the Burrows-Wheeler transform in a wavelet matrix, and every
16th suffix position. All windows of ``WORDS`` words of the evaluation texts
are searched backwards at once, one array operation per word and level of the
matrix, and located by walking to the next sampled position. Overlapping hits
of one item in one document merge into spans.

Words that no evaluation text holds can't be part of a hit, nor can runs of
fewer than ``WORDS`` other words; they are left out of the index beforehand.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.llm.lookalike import LOOKS
from bindery.session import cut

WORDS = 12
SHARD = 1_000_000
SAMPLE = 16
BLOCK = 20_000
TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->", re.S)
WORD = re.compile(r"[^\W_]+")
HIDDEN = re.compile("[\xad͏᠎​-‏‪-‮⁠-⁤︀-️﻿\x00-\x08\x0e-\x1f\x7f-\x84\x86-\x9f]")
SEEN = {ord(a): b for a, b in LOOKS.items()}
SMALL = {ord(a.lower()): b.lower() for a, b in LOOKS.items() if a.lower() != a and len(b.lower()) == 1 and b.lower() != "h"}


def words(text: str) -> list[str]:
    """Runs of letters or digits in one form: no markup, entities read, look-alikes mapped, small letters."""
    if "<" in text:
        text = TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", HIDDEN.sub("", text))
        text = unicodedata.normalize("NFC", text.translate(SEEN))
    return WORD.findall(text.casefold())


class FMIndex:
    """FM-index of an array of symbols >= 1; symbol 0 is its end."""

    def __init__(self, symbols: np.ndarray):
        t = np.append(symbols, 0).astype(np.int64)
        n = self.n = len(t)
        rank = np.unique(t, return_inverse=True)[1].astype(np.int64)
        k = 1
        while True:
            second = np.zeros(n, np.int64)
            second[: n - k] = rank[k:] + 1
            key = rank * (n + 1) + second
            sa = np.argsort(key, kind="stable")
            step = np.empty(n, np.int64)
            step[0] = 0
            step[1:] = key[sa][1:] != key[sa][:-1]
            rank = np.empty(n, np.int64)
            rank[sa] = np.cumsum(step)
            k *= 2
            if rank[sa[-1]] == n - 1 or k >= n:
                break
        bwt = t[sa - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=int(t.max()) + 1))])
        self.top = int(t.max())
        self.levels = max(1, self.top.bit_length())
        self.bits, self.zeros = [], []
        x = bwt
        for lv in range(self.levels - 1, -1, -1):
            b = (x >> lv) & 1
            self.bits.append(np.concatenate([[0], np.cumsum(b)]))
            self.zeros.append(int(len(b) - b.sum()))
            x = np.concatenate([x[b == 0], x[b == 1]])
        kept = sa % SAMPLE == 0
        self.marks = np.concatenate([[0], np.cumsum(kept)])
        self.kept = sa[kept]

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol c stands before position i of the transform."""
        at, base = i.copy(), np.zeros_like(i)
        for lv, ones, zeros in zip(range(self.levels - 1, -1, -1), self.bits, self.zeros):
            up = (c >> lv) & 1 == 1
            at = np.where(up, zeros + ones[at], at - ones[at])
            base = np.where(up, zeros + ones[base], base - ones[base])
        return at - base

    def symbol(self, i: np.ndarray) -> np.ndarray:
        c, at = np.zeros_like(i), i.copy()
        for lv, ones, zeros in zip(range(self.levels - 1, -1, -1), self.bits, self.zeros):
            b = ones[at + 1] - ones[at]
            c |= b << lv
            at = np.where(b == 1, zeros + ones[at], at - ones[at])
        return c

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 suffix of each pattern (rows of equal length)."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = np.minimum(patterns[:, j], self.top)
            there = (patterns[:, j] <= self.top) & (hi > lo)
            lo = np.where(there, self.first[c] + self.rank(c, lo), 0)
            hi = np.where(there, self.first[c] + self.rank(c, hi), 0)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the text of suffixes, by steps back to the next sampled one."""
        at, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            cur = at[open_]
            hit = self.marks[cur + 1] > self.marks[cur]
            done = open_[hit]
            out[done] = self.kept[self.marks[at[done]]] + steps[done]
            open_ = open_[~hit]
            cur = at[open_]
            c = self.symbol(cur)
            at[open_] = self.first[c] + self.rank(c, cur)
            steps[open_] += 1
        return out


class Phrases:
    """The windows of a block of evaluation texts as numbers, each with the items that hold it."""

    def __init__(self, items: list[tuple[int, list[str]]], n: int = WORDS):
        self.n = n
        self.ids: dict[str, int] = {}
        owners: dict[tuple[int, ...], set[int]] = defaultdict(set)
        for item, texts in items:
            for text in texts:
                w = [self.ids.setdefault(x, len(self.ids) + 2) for x in words(text)]
                for i in range(len(w) - n + 1):
                    owners[tuple(w[i : i + n])].add(item)
        self.windows = np.array(sorted(owners), np.int64).reshape(-1, n)
        self.owners = [np.array(sorted(owners[tuple(x)])) for x in self.windows.tolist()]

    def runs(self, text: str) -> list[tuple[int, list[int]]]:
        """Start and symbols of the runs of at least n words of the evaluation texts."""
        out, run = [], []
        get = self.ids.get
        found = [get(w, 0) for w in words(text)]
        found.append(0)
        for i, x in enumerate(found):
            if x:
                run.append(x)
            else:
                if len(run) >= self.n:
                    out.append((i - len(run), run))
                run = []
        return out


def _search(parts: list[tuple[object, int, list[int]]], p: Phrases) -> dict:
    """Spans (start, end) in words by document and item, of one shard."""
    symbols, docs, starts = [], [], []
    for doc, at, run in parts:
        symbols += [*run, 1]
        docs += [doc] * (len(run) + 1)
        starts += range(at, at + len(run) + 1)
    index = FMIndex(np.array(symbols, np.int64))
    lo, hi = index.search(p.windows)
    found = np.nonzero(hi > lo)[0]
    rows = np.concatenate([np.arange(lo[i], hi[i]) for i in found]) if len(found) else np.zeros(0, np.int64)
    which = np.repeat(found, (hi - lo)[found])
    spans = defaultdict(set)
    for w, pos in zip(which.tolist(), index.locate(rows).tolist()):
        for item in p.owners[w].tolist():
            spans[docs[pos], item].add(starts[pos])
    out = {}
    for key, at in spans.items():
        merged = []
        for s in sorted(at):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = s + p.n
            else:
                merged.append([s, s + p.n])
        out[key] = merged
    return out


def spans(docs: DataFrame, key: str, text: str, items: DataFrame, item: str, texts: list[str]) -> DataFrame:
    """``key, item_id, start, end``: merged spans, in words from 0, of ``WORDS`` or more words in a row of an item's texts.

    Null texts on either side take no part; items shorter than ``WORDS`` words
    can't be found; repeated rows count once; each item with the same text is
    reported. Items are taken in blocks of ``BLOCK``, so any number will do.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    base = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    rows = items.select(item, *texts).distinct().orderBy(item)
    schema = f"k {kind}, item_id long, start int, end int"

    def block(some: list[tuple[int, list[str]]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(Phrases(some))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            p = shared.value
            parts, size = [], 0

            def flush() -> pd.DataFrame:
                found = _search(parts, p) if parts else {}
                return pd.DataFrame([(d, i, s, e) for (d, i), m in found.items() for s, e in m], columns=["k", "item_id", "start", "end"])

            for b in batches:
                for k, t in zip(b["k"].tolist(), b["t"]):
                    for at, r in p.runs(t):
                        parts.append((k, at, r))
                        size += len(r) + 1
                    if size > SHARD:
                        yield flush()
                        parts, size = [], 0
            yield flush()

        return base.mapInPandas(run, schema)

    out, some = None, []
    for row in rows.toLocalIterator():
        if row[0] is not None:
            some.append((row[0], [t for t in row[1:] if t]))
        if len(some) == BLOCK:
            out = block(some) if out is None else cut(out.unionByName(block(some)))
            some = []
    if some or out is None:
        out = block(some) if out is None else out.unionByName(block(some))
    return out.distinct().withColumnRenamed("k", key)
