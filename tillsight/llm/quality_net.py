"""Document quality from random-indexing word vectors and a two-layer network.

Tokens are runs of letters, digits or other signs; a token equal to the one before it counts
as a token of its own kind.  Tokens are hashed to ``VOCAB`` rows.  Random indexing gives each
row a sparse ternary index vector; a row's context vector is the sum of the index vectors of
the tokens up to two places away, over the whole corpus (integer sums: the same result
in any order).  A document is the mean of its tokens' centred unit context vectors, with its
log length.  The network is trained with numpy on at most ``TRAIN`` labelled
documents; a fifth of them sets the temperature that calibrates the probabilities.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.llm._tables import ship, written
from tillsight.llm._units import in_slices
from tillsight.llm._words import hash_runs, join_texts, mix

VOCAB = 1 << 13
DIMS = 32
TRAIN = 20_000     # labelled documents the network is fitted on, those with the smallest hash
HIDDEN = 32
STEPS = 5_000       # training steps, whatever the number of documents
BATCH = 128
DECAY = 1e-3
_PART = 1 << 19    # tokens counted at a time

_KIND = np.full(256, 3, dtype=np.uint8)
_KIND[[32, 9, 10, 11, 12, 13]] = 0
for _a, _b, _k in ((65, 91, 1), (97, 123, 1), (128, 256, 1), (48, 58, 2)):
    _KIND[_a:_b] = _k
_SAME = np.arange(256, dtype=np.uint8)


def rows_of_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vocabulary row of every token of all texts, and the n + 1 bounds of each text's tokens."""
    buf, text_starts = join_texts(texts)
    starts, hashes = hash_runs(buf, _KIND, _SAME)
    bounds = np.searchsorted(starts, text_starts)
    again = np.zeros(hashes.size, dtype=bool)
    again[1:] = hashes[1:] == hashes[:-1]
    again[bounds[:-1][bounds[:-1] < hashes.size]] = False
    rows = (mix(hashes + np.uint64(1)) % np.uint64(VOCAB - 1)).astype(np.int64)
    rows[again] = VOCAB - 1
    return rows, bounds


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Dimension and sign of the two non-zero entries of each row's index vector."""
    h = mix(np.arange(2 * VOCAB, dtype=np.uint64) + np.uint64(77)).reshape(2, VOCAB)
    return (h % np.uint64(DIMS)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)


def _context_sums(batches):
    """Context vectors of this task's texts, one row for each vocabulary row that occurs."""
    dim, sign = index_vectors()
    total = np.zeros(VOCAB * DIMS)
    for batch in in_slices(batches, 0):
        rows, bounds = rows_of_texts(batch.column(0))
        text = np.repeat(np.arange(bounds.size - 1), np.diff(bounds))
        for lo in range(0, rows.size, _PART):
            r, t = rows[lo:lo + _PART + 2], text[lo:lo + _PART + 2]
            at, weight = [], []
            for step in (1, 2):
                # pairs that start in this part; the two rows beyond it belong to the next
                m = min(_PART, max(0, r.size - step))
                a, b = r[:m], r[step:step + m]
                same = t[:m] == t[step:step + m]
                a, b = a[same], b[same]
                for here, there in ((a, b), (b, a)):
                    for k in (0, 1):
                        at.append(here * DIMS + dim[k, there])
                        weight.append(sign[k, there])
            if at:
                total += np.bincount(np.concatenate(at), np.concatenate(weight), minlength=total.size)
    table = total.reshape(VOCAB, DIMS).astype(np.int64)
    used = np.flatnonzero(table.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64())] + [pa.array(table[used, d]) for d in range(DIMS)],
                                     names=["row"] + [f"v{d}" for d in range(DIMS)])


def word_vectors(docs: DataFrame, text: str) -> np.ndarray:
    """Centred unit context vectors (VOCAB x DIMS) from the whole corpus."""
    names = [f"v{d}" for d in range(DIMS)]
    sums = (docs.select(text).mapInArrow(_context_sums, "row bigint, " + ", ".join(f"{n} bigint" for n in names))
            .groupBy("row").agg(*[F.sum(n).alias(n) for n in names]).toPandas())  # VOCAB rows at most
    table = np.zeros((VOCAB, DIMS))
    table[sums["row"].to_numpy(np.int64)] = sums[names].to_numpy(np.float64)

    def unit(x: np.ndarray) -> np.ndarray:
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)

    table = unit(table)
    used = table.any(axis=1)
    if used.any():
        table[used] -= table[used].mean(axis=0)
    return unit(table).astype(np.float32)


def pooled(docs: DataFrame, key: str, text: str, vectors: np.ndarray) -> DataFrame:
    """``key`` and ``features`` (array<float>) of every document."""
    held = ship(docs.sparkSession, vectors)

    def run(batches):
        table = held.value
        for batch in in_slices(batches, 1):
            rows, bounds = rows_of_texts(batch.column(1))
            feats = np.zeros((batch.num_rows, DIMS + 1), dtype=np.float32)
            for i in range(batch.num_rows):
                part = rows[bounds[i]:bounds[i + 1]]
                if part.size:
                    total = np.zeros(DIMS)
                    for lo in range(0, part.size, _PART):
                        total += table[part[lo:lo + _PART]].sum(axis=0, dtype=np.float64)
                    feats[i, :DIMS] = total / part.size
                feats[i, DIMS] = np.log1p(part.size) / 10
            flat = pa.array(feats.ravel(), pa.float32())
            offsets = pa.array(np.arange(0, feats.size + 1, DIMS + 1), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, flat)],
                                             names=[key, "features"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, features array<float>")


class Net:
    """Standardised inputs, one hidden tanh layer, one output; probabilities at a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.mean, self.std = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (0.0, 1.0)
        n = x.shape[1]
        self.w = [rng.normal(0, n ** -0.5, (n, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN ** -0.5, HIDDEN),
                  np.zeros(1)]
        self.temperature = 1.0
        if len(x) < 10 or y.min() == y.max():  # nothing to learn: the share of good labels, 1/2 without labels
            share = (y.sum() + 1) / (len(y) + 2)
            self.w[2][:] = 0
            self.w[3][0] = np.log(share / (1 - share))
            return
        order = rng.permutation(len(x))
        held, used = order[:len(x) // 5], order[len(x) // 5:]
        self._fit(x[used], y[used], rng)
        self._calibrate(self.logits(x[held]), y[held])

    def _fit(self, x: np.ndarray, y: np.ndarray, rng) -> None:
        x = (x - self.mean) / self.std
        first, second = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w]
        step = 0
        for _ in range(-(-STEPS // -(-len(x) // BATCH))):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), BATCH):
                xb, yb = x[order[lo:lo + BATCH]], y[order[lo:lo + BATCH]]
                h = np.tanh(xb @ self.w[0] + self.w[1])
                e = (1 / (1 + np.exp(-np.clip(h @ self.w[2] + self.w[3], -30, 30))) - yb) / len(xb)
                back = np.outer(e, self.w[2]) * (1 - h * h)
                grads = [xb.T @ back + DECAY * self.w[0], back.sum(axis=0), h.T @ e + DECAY * self.w[2],
                         np.array([e.sum()])]
                step += 1
                for k, g in enumerate(grads):
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    self.w[k] -= 0.003 * (first[k] / (1 - 0.9 ** step)) / (
                        np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)

    def _calibrate(self, z: np.ndarray, y: np.ndarray) -> None:
        def loss(t: float) -> float:
            return float(np.mean(np.logaddexp(0, z / t) - y * z / t))
        self.temperature = min(np.exp(np.linspace(-2, 3, 101)), key=loss)

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh(((x - self.mean) / self.std) @ self.w[0] + self.w[1])
        return h @ self.w[2] + self.w[3]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def quality_scores(docs: DataFrame, labels: DataFrame, may_learn: Column, key: str = "doc_id", text: str = "text",
                   label: str = "quality") -> DataFrame:
    """``key``, ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) of every row of ``docs``.

    Labels are learnt only where ``may_learn``, an expression over ``key``, holds; a key labelled
    twice counts once, as good if any row says so.  Null and empty texts are scored like any
    other, by their length alone.  An empty table, or one without labels, gives the share of good
    labels.  Only ``key`` and ``text`` are read; repeated rows are scored alike.
    """
    docs = docs.select(key, text)
    feats = written(pooled(docs, key, text, word_vectors(docs, text)), "quality-features")
    known = (labels.where(may_learn & F.col(label).isin(0, 1)).groupBy(key).agg(F.max(label).alias("_y"))
             .orderBy(F.xxhash64(key), key).limit(TRAIN))
    # TRAIN rows at most on this side; a key that is in docs many times is learnt once
    rows = (feats.join(F.broadcast(known), key).groupBy(key).agg(F.min("features").alias("x"), F.first("_y").alias("y"))
            .orderBy(key).toPandas())
    x = np.array(rows["x"].tolist(), dtype=np.float64).reshape(len(rows), DIMS + 1)
    net = ship(docs.sparkSession, Net(x, rows["y"].to_numpy(np.float64)))

    def run(batches):
        for batch in batches:
            x = np.asarray(batch.column(1).flatten(), dtype=np.float64).reshape(-1, DIMS + 1)
            p = net.value.probabilities(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                                             names=[key, "score", "predicted"])

    kind = docs.schema[key].dataType.simpleString()
    return feats.mapInArrow(run, f"`{key}` {kind}, score double, predicted int")
