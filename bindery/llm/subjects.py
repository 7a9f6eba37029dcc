"""Problem 8: the subject areas of each document.

A document is a bag of passages: its sentences and its pieces of code. A
passage is the average of embeddings of its words, pairs of words and letter
groups (hashed), and each subject has its own logistic output. Labels stand on
documents, so a document has a subject if any passage has (noisy or): labels
teach which passages speak of a subject, and which set phrases don't.

Training is synchronous: in each round every partition computes the gradient
over its documents, one task adds them up in the order of the partitions and
the driver takes one step. Only the sum, of the size of the model (two
megabytes), reaches the driver, however many partitions or documents there are.
Labelled documents are a sample of at most ``MAX_LABELLED``, in an order by
hash; every document is scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.llm.leaks import words
from bindery.session import cut

MAX_LABELLED = 20_000
BUCKETS = 1 << 15
DIM = 16
ROUNDS = 90
RATE = 0.05
DECAY = 1e-5
PARTS = 8
PACK = 4096  # documents in one row of arrays
QUOTED = 8
SPREAD = 0.2
MIN_CODE = 4  # a shorter piece of code belongs to its sentence
BLOCK = 20_000  # evaluation texts held at a time
THRESHOLD = 0.25
CODE = re.compile(r"```.*?(?:```|\Z)|<pre\b.*?(?:</pre>|\Z)|<code\b.*?(?:</code>|\Z)|`[^`\n]+`|(?:(?:^|(?<=<p>))(?:    |\t)[^\n]*(?:\n|\Z))+", re.S | re.M)
BREAK = re.compile(r"(?<=[.!?:])\s+|\n[\s>]*\n|</?(?:p|br|li|ul|ol|blockquote|h\d|div)\b[^<>]*>")


def passages(text: str) -> list[tuple[bool, list[str]]]:
    """Pieces of code and sentences, as words; whether it is code."""
    out, rest, at = [], [], 0
    for m in CODE.finditer(text):
        w = words(m[0])
        if len(w) < MIN_CODE:
            continue
        rest.append(text[at : m.start()])
        at = m.end()
        out.append((True, w))
    rest.append(text[at:])
    for piece in BREAK.split("\n".join(rest)):
        w = words(piece)
        if w:
            out.append((False, w))
    return out


def _bucket(feature: str) -> int:
    return xxhash.xxh3_64_intdigest(feature) % BUCKETS


def _windows(w: list[str]) -> list[int]:
    return [xxhash.xxh3_64_intdigest(" ".join(w[i : i + QUOTED])) for i in range(len(w) - QUOTED + 1)]


class Quotes:
    """Hashes of the windows of ``QUOTED`` words of one block of evaluation texts."""

    def __init__(self, texts: list[str]):
        self.windows = np.unique(np.array([x for t in texts for x in _windows(words(t))], np.uint64))

    def passages(self, text: str | None) -> list[int]:
        """The numbers of the passages that quote one of the texts."""
        out = []
        for i, (_, w) in enumerate(passages(text or "")):
            if len(w) >= QUOTED and len(self.windows):
                x = np.array(_windows(w), np.uint64)
                at = np.minimum(np.searchsorted(self.windows, x), len(self.windows) - 1)
                if (self.windows[at] == x).any():
                    out.append(i)
        return out


class Features:
    """Feature numbers of passages."""

    def __init__(self):
        self.seen: dict[str, list[int]] = {}

    def of_word(self, w: str) -> list[int]:
        hit = self.seen.get(w)
        if hit is None:
            hit = [_bucket(w)]
            if len(w) > 5:
                x = f"<{w}>"
                hit += [_bucket(f"#{x[i : i + 5]}") for i in range(len(x) - 4)]
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[w] = hit
        return hit

    def of_text(self, text: str | None, quoted: list[int] = ()) -> list[list[int]]:
        """Of all passages but those numbered in ``quoted``."""
        out = []
        for i, (code, w) in enumerate(passages(text or "")):
            if i in quoted:
                continue
            f = [x for t in w for x in self.of_word(t)]
            f += [_bucket(f"{a} {b}") for a, b in zip(w, w[1:])]
            if code:
                f += [_bucket("code piece")] * max(1, len(f) // 3)
            out.append(f)
        return out


def without_quotes(docs: DataFrame, quoted: Iterable[list[str]]) -> DataFrame:
    """``docs`` (column ``t``) with ``q``: the numbers of the passages that quote an evaluation text.

    ``quoted`` gives the evaluation texts in blocks; each block is broadcast by
    itself, as hashes, so any number of texts will do.
    """
    names = docs.columns
    out = docs.withColumn("q", F.array().cast("array<int>"))
    for block in quoted:
        shared = docs.sparkSession.sparkContext.broadcast(Quotes(block))

        def mark(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            x = shared.value
            for b in batches:
                yield b.assign(q=[sorted({*map(int, q), *x.passages(t)}) for q, t in zip(b["q"], b["t"])])

        out = out.mapInPandas(mark, out.select(*names, "q").schema)
    return out


def blocks(texts: Iterable[str | None]) -> Iterator[list[str]]:
    """Texts in blocks of ``BLOCK``, without nulls and repeated neighbours."""
    block: list[str] = []
    last = None
    for t in texts:
        if t and t != last:
            block.append(t)
            last = t
        if len(block) == BLOCK:
            yield block
            block = []
    if block:
        yield block


class Model:
    def __init__(self, subjects: list[str]):
        rng = np.random.default_rng(7)
        self.subjects = subjects
        self.e = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.w = rng.normal(0, 0.3, (len(subjects), DIM)).astype(np.float32)
        self.b = np.full(len(subjects), -2.0, np.float32)
        self.moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (self.e, self.w, self.b)]
        self.steps = 0

    def hidden(self, flat: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.e[flat], starts, axis=0) / n[:, None]

    def logits(self, passages_: list[list[int]]) -> np.ndarray:
        n = np.array([len(p) for p in passages_])
        flat = np.concatenate([np.asarray(p, np.int64) for p in passages_])
        return self.hidden(flat, np.concatenate([[0], np.cumsum(n)[:-1]]), n) @ self.w.T + self.b

    def gradient(self, flat: np.ndarray, n: np.ndarray, docs: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the documents' loss; ``n`` features per passage, ``docs`` passages per document, labels ``y``."""
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        h = self.hidden(flat, starts, n)
        z = h @ self.w.T + self.b
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        of = np.repeat(np.arange(len(docs)), docs)
        q = np.add.reduceat(np.log1p(-np.minimum(s, 1 - 1e-6)), np.concatenate([[0], np.cumsum(docs)[:-1]]), axis=0)
        q = np.exp(q)
        pull = np.where(y > 0.5, -np.minimum(q / np.maximum(1 - q, 1e-3), 50), 1.0)
        g = s * pull[of]
        # in a document of one subject most passages speak of it
        one = (y.sum(1) == 1)[of]
        g[one] += SPREAD * (s - y[of])[one]
        gh = (g @ self.w) / n[:, None]
        order = np.argsort(flat, kind="stable")
        f = flat[order]
        first = np.concatenate([[0], np.nonzero(np.diff(f))[0] + 1])
        ge = np.zeros_like(self.e)
        ge[f[first]] = np.add.reduceat(gh[np.repeat(np.arange(len(n)), n)[order]], first, axis=0)
        return [ge, (g.T @ h).astype(np.float32), g.sum(0).astype(np.float32)]

    def step(self, gradients: list[np.ndarray]) -> None:
        self.steps += 1
        for x, g, (m, v) in zip((self.e, self.w, self.b), gradients, self.moments):
            m += 0.1 * (g - m)
            v += 0.02 * (g * g - v)
            x -= RATE * (m / (1 - 0.9**self.steps) / (np.sqrt(v / (1 - 0.98**self.steps)) + 1e-8) + DECAY * x)

    def subjects_of(self, passages_: list[list[int]], threshold: float = THRESHOLD) -> list[str]:
        if not passages_:
            return []
        top = self.logits(passages_).max(0)
        return [s for s, z in zip(self.subjects, top) if z > threshold]

    def bare(self) -> Model:
        """The model without what only training needs."""
        self.moments = []
        return self


ARRAYS = {"flat": np.int32, "n": np.int32, "docs": np.int32, "y": np.float32}


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The documents of a partition as few rows of plain arrays, which each round reads without a step per document."""
    rows: list[tuple[list[int], list[int], list[float]]] = []

    def pack() -> pd.DataFrame:
        parts = {"flat": [x for f, _, _ in rows for x in f], "n": [k for _, n, _ in rows for k in n], "docs": [len(n) for _, n, _ in rows], "y": [v for _, _, y in rows for v in y]}
        return pd.DataFrame({k: [np.asarray(v, ARRAYS[k]).tobytes()] for k, v in parts.items()})

    for b in batches:
        for row in zip(b["flat"], b["n"], b["y"]):
            rows.append(tuple(list(x) for x in row))
            if len(rows) == PACK:
                yield pack()
                rows = []
    if rows:
        yield pack()


def _arrays(b: pd.DataFrame, subjects: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for row in zip(*[b[k] for k in ARRAYS]):
        flat, n, docs, y = (np.frombuffer(x, t) for x, t in zip(row, ARRAYS.values()))
        yield flat.astype(np.int64), n.astype(np.int64), docs.astype(np.int64), y.reshape(-1, subjects)


def _added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sum of the partitions' gradients, always in the same order."""
    rows = sorted((part, g) for b in batches for part, g in zip(b["part"], b["g"]))
    total = np.zeros(len(rows[0][1]) // 4, np.float32) if rows else None
    for _, g in rows:
        total += np.frombuffer(g, np.float32)
    if rows:
        yield pd.DataFrame({"g": [total.tobytes()]})


def fit(docs: DataFrame, key: str, text: str, labels: DataFrame, label: str, subjects: list[str], quoted: Iterable[list[str]]) -> Model:
    """A model trained on the labelled documents.

    Labels are compared without case and blanks around them; those that name
    no subject (``none``) mean that no subject fits. Repeated labels count once.
    Only labelled documents are shuffled: their keys, ``MAX_LABELLED`` at most,
    are broadcast to the scan of all.
    """
    spark = docs.sparkSession
    spelled = {s.strip().lower(): s for s in subjects}
    known = labels.select(F.col(key).alias("k"), F.lower(F.trim(F.col(label))).alias("s")).where("k is not null and s is not null")
    known = cut(known.groupBy("k").agg(F.collect_set("s").alias("s")).orderBy(F.xxhash64("k"), "k").limit(MAX_LABELLED))
    features = spark.sparkContext.broadcast(Features())

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = features.value
        for b in batches:
            rows = []
            for t, q, s in zip(b["t"], b["q"], b["s"]):
                p = f.of_text(t, list(q))
                if p:
                    has = {spelled.get(x) for x in s}
                    rows.append(([x for q in p for x in q], [len(q) for q in p], [float(x in has) for x in subjects]))
            yield pd.DataFrame(rows, columns=["flat", "n", "y"])

    base = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null").join(F.broadcast(known), "k")
    base = base.repartition(PARTS, "k").groupBy("k").agg(F.min("t").alias("t"), F.first("s").alias("s"))
    data = cut(without_quotes(base, quoted).mapInPandas(encode, "flat array<int>, n array<int>, y array<float>").mapInPandas(_packed, "flat binary, n binary, docs binary, y binary"))
    model = Model(subjects)
    if data.isEmpty():
        return model.bare()
    for _ in range(ROUNDS):
        now = spark.sparkContext.broadcast((model.e, model.w, model.b))

        def gradient(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            m = Model.__new__(Model)
            m.e, m.w, m.b = now.value
            total = None
            for b in batches:
                for x in _arrays(b, len(subjects)):
                    g = np.concatenate([g.ravel() for g in m.gradient(*x)]).astype(np.float32)
                    total = g if total is None else total + g
            if total is not None:
                yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "g": [total.tobytes()]})

        total = np.frombuffer(data.mapInPandas(gradient, "part int, g binary").repartition(1).mapInPandas(_added, "g binary").first()[0], np.float32)
        now.destroy()
        a, b = BUCKETS * DIM, BUCKETS * DIM + len(subjects) * DIM
        model.step([total[:a].reshape(BUCKETS, DIM), total[a:b].reshape(-1, DIM), total[b:]])
    return model.bare()


def assign(docs: DataFrame, key: str, text: str, model: Model, quoted: Iterable[list[str]]) -> DataFrame:
    """``key, subject``: every subject that some passage of a document's text is found to treat.

    Null and empty texts have none; repeated rows count once.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    shared = spark.sparkContext.broadcast((model, Features()))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, f = shared.value
        for b in batches:
            rows = [(k, s) for k, t, q in zip(b["k"], b["t"], b["q"]) for s in m.subjects_of(f.of_text(t, list(q)))]
            yield pd.DataFrame(rows, columns=["k", "subject"])

    base = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    return without_quotes(base, quoted).mapInPandas(score, f"k {kind}, subject string").distinct().withColumnRenamed("k", key)
