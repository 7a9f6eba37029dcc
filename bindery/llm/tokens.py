"""Problem 6: the whole corpus as token ids of a public byte-level BPE tokenizer.

Two tiers. A minimal perfect hash over the vocabulary (hash and displace, built
once on the driver from the tokenizer's file and broadcast; its size is that of
the vocabulary) resolves pre-tokens that are tokens themselves. The others are
merged with a heap over linked bytes, best rank first, leftmost at ties, in
n log n steps also for very long runs. Ids of frequent pre-tokens are kept per
worker in a table of bounded size.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the published pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEPT = 200_000
MIX = np.uint64(0x9E3779B97F4A7C15)


class PerfectHash:
    """Minimal perfect hash of byte strings: n keys to the slots 0..n-1 and from there to their values."""

    def __init__(self, keys: list[bytes], values: list[int]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 2)
        h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        self.shift = np.zeros(self.buckets, np.int64)
        taken = np.zeros(n, bool)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        slots = np.zeros(n, np.int64)
        free = None
        for b in np.argsort(-np.diff(starts), kind="stable"):
            own = order[starts[b] : starts[b + 1]]
            if len(own) > 1:
                d, at = 0, None
                while at is None:  # a row of displacements at a time
                    tries = self._slot(h[own][None, :], np.arange(d, d + 32)[:, None])
                    for r in np.nonzero(~taken[tries].any(axis=1))[0]:
                        if len(set(tries[r].tolist())) == len(own):
                            self.shift[b], at = d + r, tries[r]
                            break
                    d += 32
            elif len(own) == 1:  # a bucket of one key names its slot
                free = iter(np.nonzero(~taken)[0].tolist()) if free is None else free
                at = np.array([next(free)])
                self.shift[b] = -1 - at[0]
            else:
                break
            slots[own] = at
            taken[at] = True
        self.keys, self.values = np.empty(n, object), np.zeros(n, np.int32)
        self.keys[slots] = keys
        self.values[slots] = values

    def _slot(self, h: np.ndarray, d: np.ndarray | np.int64) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (h ^ (d.astype(np.uint64) * MIX)) * np.uint64(0xFF51AFD7ED558CCD)
            at = ((x ^ (x >> np.uint64(33))) % np.uint64(self.n)).astype(np.int64)
        return np.where(d < 0, -1 - d, at)

    def get(self, keys: list[bytes]) -> list[int]:
        """The values, -1 where a key isn't in the table."""
        if not keys:
            return []
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
        at = self._slot(h, self.shift[(h % np.uint64(self.buckets)).astype(np.int64)])
        found = self.keys[at]
        return [int(v) if k == f else -1 for k, f, v in zip(keys, found, self.values[at])]


class Encoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.table = PerfectHash(list(ranks), list(ranks.values()))
        self.known: dict[str, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of one pre-token by merging its bytes, lowest rank first."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # where the part that starts here ends; 0 if it was merged away
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        split = _pattern().findall
        known = self.known
        pieces = [split(t) if t else [] for t in texts]
        new = list({p for ps in pieces for p in ps if p not in known})
        if new:
            if len(known) + len(new) > KEPT:
                known.clear()
                new = list({p for ps in pieces for p in ps})
            raw = [p.encode() for p in new]
            for p, b, v in zip(new, raw, self.table.get(raw)):
                known[p] = [v] if v >= 0 else self.merge(b)
        return [[i for p in ps for i in known[p]] for ps in pieces]


@cache
def _pattern():
    import regex

    return regex.compile(PATTERN)


def ranks_of(path: str) -> dict[bytes, int]:
    """Tokens and ids of a rank file: a base64 token and its id on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def encode(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """``key, ids``: one row for each key, without special tokens.

    An empty text and a null text both give an empty list. Of rows that repeat
    a key the smallest text counts. A null key is a key like others. Strings
    that look like special tokens are ordinary text.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(Encoder(ranks_of(path)))
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = shared.value
        for b in batches:
            yield pd.DataFrame({"k": b["k"], "ids": e.encode(b["t"].tolist())})

    one = df.select(F.col(key).alias("k"), F.col(text).alias("t")).groupBy("k").agg(F.min("t").alias("t"))
    return one.mapInPandas(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)
