"""Quality scores: random-indexing word vectors pooled per document, then a two-layer network with calibrated probabilities.

1. Each word stands for two tokens, its lower-case letters and its shape (runs of capitals, small letters and digits as one sign
   each, all other signs as they are), each hashed to one of `buckets`. A bucket has a fixed sparse random index vector; its word
   vector is the sum of the index vectors of its neighbours over the whole corpus. Every task adds up its own table of fixed
   size, and the tables are summed by bucket.
2. A document's features are the means of its tokens' vectors and a few ratios (distinct words, repeated neighbours, length).
3. The network is trained on the driver from a sample of at most `sample` labelled rows (those with the least hash of their id).
   A fifth of these is held back to fit the temperature that calibrates the probabilities.

Neither labels, language, source nor ids are features. Null or empty texts have the features of no words and are scored like any
other. Null labels are ignored; without labels of both classes every score is the share of label 1, or 0.5 without labels.
Repeated rows are scored each; of those that share a sampled id and label, two are learnt from, whose texts have the least hashes.
Equal texts have equal scores; a score that is 0.7 to nine digits counts as at least 0.7. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import slices, sole, texts_of, with_columns

#: Words held by a Python worker; beyond, it starts anew.
HELD = 300_000
CAPITALS, SMALL, NUMBERS = re.compile("[^\\W\\d_a-zß-öø-ÿ]+"), re.compile("[^\\W\\d_A-ZÀ-ÖØ-Þ]+"), re.compile("[0-9]+")


@dataclass(frozen=True)
class Settings:
    buckets: int = 2048
    size: int = 16
    nonzero: int = 2
    window: int = 1
    hidden: int = 32
    epochs: int = 40
    sample: int = 20_000
    seed: int = 7


def shape(word: str) -> str:
    return NUMBERS.sub("0", CAPITALS.sub("\x01", SMALL.sub("\x02", word)))


class Tokens:
    """The two buckets of each word, letters' << 16 | shape's."""

    def __init__(self, buckets: int):
        self.buckets, self.held = buckets, {}

    def _new(self, word: str) -> int:
        core = word.rstrip(".,;:!?%$&*#|")
        if core.isalpha():
            letters, form = core.lower(), ("\x02" if core.islower() else "\x01" if core.isupper() else "\x01\x02") + word[len(core) :]
        else:
            letters, form = word.lower(), shape(word)
        code = lambda x: xxhash.xxh32_intdigest(x.encode("utf-8", "surrogatepass")) % self.buckets
        return code(letters) << 16 | code(form)

    def __call__(self, words: list[str]) -> np.ndarray:
        held = self.held
        try:
            return np.fromiter(map(held.__getitem__, words), np.int64, len(words))
        except KeyError:
            if len(held) > HELD:
                held.clear()
            for w in words:
                if w not in held:
                    held[w] = self._new(w)
            return np.fromiter(map(held.__getitem__, words), np.int64, len(words))


def tokens(buckets: int) -> Tokens:
    return sole(("quality", buckets), lambda: Tokens(buckets))


def index_vectors(s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero values of each bucket, of letters and then of shapes."""
    r = np.random.Generator(np.random.PCG64(s.seed))
    return r.integers(0, s.size, (2 * s.buckets, s.nonzero)), r.choice([-1.0, 1.0], (2 * s.buckets, s.nonzero))


def word_vectors(docs: DataFrame, s: Settings) -> np.ndarray:
    """The vectors of all buckets, of length 1, from the neighbours in all texts. The driver gets 2 * buckets rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, (places, signs) = tokens(s.buckets), index_vectors(s)
        total = np.zeros(2 * s.buckets * s.size)
        for batch in slices(batches, 512):
            rows = [ids_of(words) for t in texts_of(batch) if (words := t.split())]
            if not rows:
                continue
            both = np.concatenate(rows)
            doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
            for view in (both >> 16, (both & 0xFFFF) + s.buckets):
                for lag in range(1, s.window + 1):
                    near = np.flatnonzero(doc[lag:] == doc[:-lag])
                    left, right = view[near], view[near + lag]
                    for k in range(s.nonzero):
                        total += np.bincount(left * s.size + places[right, k], signs[right, k], len(total))
                        total += np.bincount(right * s.size + places[left, k], signs[left, k], len(total))
        table = total.reshape(-1, s.size)
        used = np.flatnonzero(table.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array(table[used, k]) for k in range(s.size))], names)

    names = ["bucket", *(f"v{k}" for k in range(s.size))]
    parts = with_columns(docs, {"text": "string"}).mapInArrow(add, "bucket int, " + ", ".join(f"v{k} double" for k in range(s.size)))
    rows = parts.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names[1:]]).collect()
    out = np.zeros((2 * s.buckets, s.size))
    for r in rows:
        out[r.bucket] = r[1:]
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def features_of(texts: list[str], vectors: np.ndarray, s: Settings) -> np.ndarray:
    """A row of 2 * size + 4 features for each text."""
    ids_of, out = tokens(s.buckets), np.zeros((len(texts), 2 * s.size + 4), np.float32)
    split = [t.split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    rows = [ids_of(w) for w in split if w]
    has = np.flatnonzero(sizes)
    if len(has):
        both, starts = np.concatenate(rows), np.r_[0, np.cumsum(sizes[has])[:-1]]
        out[has, : s.size] = np.add.reduceat(vectors[both >> 16], starts, axis=0) / sizes[has, None]
        out[has, s.size : 2 * s.size] = np.add.reduceat(vectors[(both & 0xFFFF) + s.buckets], starts, axis=0) / sizes[has, None]
        same = np.r_[0, np.cumsum(np.r_[False, both[1:] == both[:-1]])]
        ends = starts + sizes[has]
        out[has, -2] = (same[ends] - same[np.minimum(starts + 1, ends)]) / sizes[has]
    out[:, -4] = [len(set(w)) / len(w) if w else 0 for w in split]
    out[:, -3] = np.log1p(sizes)
    out[:, -1] = [len(t) / len(w) / 10 if w else 0 for t, w in zip(texts, split, strict=True)]
    return out


@dataclass
class Network:
    """p = sigmoid((relu(x w1 + b1) w2 + b2) / temperature) on standardised x; constant where there is nothing to learn."""

    constant: float | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    layers: list[np.ndarray] | None = None
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum(np.clip((x - self.mean) / self.scale, -8, 8) @ w1 + b1, 0) @ w2 + b2

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x.astype(np.float64)) / self.temperature, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, s: Settings) -> Network:
    """Adam on the cross-entropy of four fifths of the rows, then the temperature of least cross-entropy on the rest."""
    if len(set(y.tolist())) < 2:
        return Network(constant=float(y.mean()) if len(y) else 0.5)
    r = np.random.Generator(np.random.PCG64(s.seed))
    x, y, order = x.astype(np.float64), y.astype(np.float64), r.permutation(len(y))
    rest, own = order[: len(y) // 5], order[len(y) // 5 :]
    net = Network(mean=x[own].mean(0), scale=x[own].std(0) + 1e-3)
    d = x.shape[1]
    net.layers = p = [r.normal(0, (2 / d) ** 0.5, (d, s.hidden)), np.zeros(s.hidden), r.normal(0, s.hidden**-0.5, s.hidden), np.zeros(())]
    z = np.clip((x - net.mean) / net.scale, -8, 8)
    m, v, t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for _ in range(s.epochs):
        r.shuffle(own)
        for k in range(0, len(own), 128):
            b = own[k : k + 128]
            h = z[b] @ p[0] + p[1]
            a = np.maximum(h, 0)
            g = (1 / (1 + np.exp(-np.clip(a @ p[2] + p[3], -40, 40))) - y[b]) / len(b)
            gh = np.outer(g, p[2]) * (h > 0)
            grads = [z[b].T @ gh + 1e-4 * p[0], gh.sum(0), a.T @ g + 1e-4 * p[2], g.sum()]
            t += 1
            for i, q in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * q
                v[i] = 0.999 * v[i] + 0.001 * q * q
                p[i] = p[i] - 3e-3 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    if len(rest):
        logits = net.logits(x[rest])
        loss = lambda c: np.logaddexp(0, -np.where(y[rest] > 0, 1, -1) * logits / c).mean()
        net.temperature = float(min(np.geomspace(0.5, 8, 40), key=loss))
    return net


def classifier(docs: DataFrame, labels: DataFrame, learn: Column, s: Settings = Settings()) -> tuple[np.ndarray, Network]:
    """Word vectors and network. learn: which rows of labels (doc_id, quality) may be learnt from."""
    docs, spark = with_columns(docs, {"doc_id": "long", "text": "string"}), docs.sparkSession
    vectors = word_vectors(docs, s)
    known = labels.where(learn).select("doc_id", F.col("quality").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    # at most s.sample rows
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(s.sample)
    held = spark.sparkContext.broadcast(vectors)

    def see(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            x = features_of(texts_of(batch), held.value, s)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "label", "x"])

    # of rows that share an id and label, the two whose texts have the least hashes
    first = Window.partitionBy("doc_id", "label").orderBy(F.xxhash64("text"), "text")
    few = docs.join(F.broadcast(sample), "doc_id").withColumn("_nth", F.row_number().over(first)).where("_nth <= 2")
    seen = few.select("doc_id", "label", "text").mapInArrow(see, "doc_id long, label int, x binary")
    rows = sorted((r.doc_id, r.label, bytes(r.x)) for r in seen.collect())
    x = np.frombuffer(b"".join(r[2] for r in rows), np.float32).reshape(len(rows), 2 * s.size + 4)
    return vectors, fit(x, np.array([r[1] for r in rows]), s)


def scored(docs: DataFrame, labels: DataFrame, learn: Column, s: Settings = Settings(), extra: str = "") -> DataFrame:
    """doc_id, score, and the columns of extra (a schema string of columns of docs) for each row of docs."""
    vectors, net = classifier(docs, labels, learn, s)
    held = docs.sparkSession.sparkContext.broadcast((vectors, net))
    more = [c.split()[0] for c in extra.split(",") if c.strip()]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, net = held.value
        for batch in slices(batches, 512):
            p = np.round(net(features_of(texts_of(batch), vectors, s)), 9)  # the last digits depend on the batch
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, pa.float64()), *map(batch.column, more)], ["doc_id", "score", *more])

    kinds = {"doc_id": "long", "text": "string"} | {c.split()[0]: c.split()[1] for c in extra.split(",") if c.strip()}
    return with_columns(docs, kinds).mapInArrow(score, "doc_id long, score double" + (f", {extra}" if extra else ""))
