"""Hard negatives for contrastive training, by slot-decomposed selection.

An anchor's positives are its best rows of the same label.  For each positive the hardest rows of other labels are
wanted whose score lies between ``LOW`` and ``HIGH`` percent of the positive's.  These windows overlap; their
upper limits cut the scores into disjoint slots:

    slot 0 (u1, u0], slot 1 (u2, u1], ..., last slot [lowest lower limit, u last]

Every task keeps the top k of each anchor and slot (a combiner that is independent of the number of rows), the tasks'
tops are merged, and a window's best k are the first k of the merge of its own slot and all lower ones, its lower
limit applied at the end: a slot serves every window that holds it, and no window is searched by itself.

Scores are exact integer inner products of ``floor(SCALE * x)``; higher first, ties by smaller id.

Anchors are worked in blocks of bounded size, broadcast to a scan of all rows: one scan finds
the positives, a second one the slots' tops; no row is shuffled, only tops are.  Each block's pairs are written,
so a lost executor repeats some tasks of one scan.

Rows with a null id, label, vector or component, or a component that isn't finite, take no part.  Vectors of unequal
length count as if padded with zeros.  Rows with the anchor's id aren't its positives or negatives; repeated
rows of other ids count as often as they occur, and equal rows of an anchor are one anchor.  Scores that could
pass 2**55 raise ArithmeticError.  Only the named columns are read, whatever the others are called.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillsight.llm._tables import ship, written
from tillsight.session import scratch_table_path

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95
#: Bytes of vectors and number of anchors of a block, at most (on average half of it).
BLOCK_BYTES, BLOCK_ANCHORS = 1 << 25, 1 << 13
#: Scores computed at once in a task.
TILE = 1 << 21
_LEAST = -(1 << 62)

RESULT = ("anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, "
          "negative_score bigint")


def quantised(vectors: pa.Array, width: int = 0) -> np.ndarray:
    """Rows of ``floor(SCALE * x)`` as doubles, padded with zeros to the longest or to ``width``."""
    values = np.floor(SCALE * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(width, int(sizes.max(initial=0)))
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(values.size) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def scores(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where all sums are exact, else in 64-bit integers."""
    width = max(rows.shape[1], anchors.shape[1])
    rows, anchors = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) if m.shape[1] < width else m for m in (rows, anchors))
    most = float(np.abs(rows).max(initial=0)) * float(np.abs(anchors).max(initial=0)) * width
    if most < 1 << 53:
        return rows @ anchors.T
    if most < 1 << 55:
        return rows.astype(np.int64) @ anchors.astype(np.int64).T
    raise ArithmeticError("inner products of these vectors could pass 2**55")


class Tops:
    """The ``k`` best (score, id) of each of ``n`` groups."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), _LEAST, np.int64)
        self.id = np.full((n, k), np.iinfo(np.int64).max, np.int64)

    @property
    def worst(self) -> np.ndarray:
        """A score below this can't enter the group."""
        return self.score[:, -1]

    def offer(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        last, last_id = self.score[group, -1], self.id[group, -1]
        use = (score > last) | (score == last) & (ids < last_id)
        group, score, ids = group[use], score[use], ids[use]
        touched = np.unique(group)
        if not touched.size:
            return
        group = np.concatenate((group, np.repeat(touched, self.k)))
        score = np.concatenate((score, self.score[touched].ravel()))
        ids = np.concatenate((ids, self.id[touched].ravel()))
        order = np.lexsort((ids, -score, group))
        group, score, ids = group[order], score[order], ids[order]
        first = np.searchsorted(group, touched)
        at = first[:, None] + np.arange(self.k)  # every touched group has k old entries at least
        self.score[touched], self.id[touched] = score[at], ids[at]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        group, place = np.nonzero(self.score > _LEAST)
        return group, self.score[group, place], self.id[group, place]


def _tiles(n_rows: int, n_anchors: int):
    """Row ranges of at most ``TILE`` scores, small ones first so that bounds are known before the large ones."""
    lo, size = 0, 64
    while lo < n_rows:
        hi = min(n_rows, lo + max(1, min(size, TILE // max(1, n_anchors))))
        yield lo, hi
        lo, size = hi, size * 4


def _columns(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    return ids.astype(np.int64), labels.astype(np.int64), quantised(batch.column(2))


def _best_of_label(anchors, k: int):
    """Per task: each anchor's ``k`` best rows of its own label."""
    def run(batches):
        ids_a, labels_a, of_a = anchors.value
        tops = Tops(ids_a.size, k)
        for batch in batches:
            ids, labels, of = _columns(batch)
            for label in np.unique(labels):
                mine, here = np.flatnonzero(labels_a == label), np.flatnonzero(labels == label)
                for lo, hi in _tiles(here.size, mine.size) if mine.size else ():
                    rows = here[lo:hi]
                    s = scores(of[rows], of_a[mine])
                    r, a = np.nonzero(s >= tops.worst[mine].astype(s.dtype))
                    other = ids[rows[r]] != ids_a[mine[a]]
                    r, a = r[other], a[other]
                    tops.offer(mine[a], s[r, a].astype(np.int64), ids[rows[r]])
        group, score, ids = tops.rows()
        yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(score), pa.array(ids)],
                                         names=["anchor", "score", "id"])
    return run


def slot_edges(best: np.ndarray, low: int, high: int) -> np.ndarray:
    """Edges of the slots of every anchor, descending: slot ``s`` holds the scores in ``(edge[s + 1], edge[s]]``.

    ``best`` has the positives' scores in descending order, ``_LEAST`` where there are fewer.  A negative score
    has an empty window, so it makes no slot.
    """
    n, k = best.shape
    edges = np.full((n, k + 1), _LEAST, np.int64)
    least = np.full(n, _LEAST, np.int64)
    for s in range(k):
        has = best[:, s] >= 0
        edges[has, s] = high * best[has, s] // 100
        least[has] = -(-low * best[has, s] // 100) - 1
    for s in range(k + 1):
        closed = best[:, s] < 0 if s < k else np.ones(n, bool)
        edges[closed, s] = least[closed]
    return edges


def _best_of_slots(anchors, edges, k: int):
    """Per task: the ``k`` best rows of other labels in each slot of each anchor."""
    def run(batches):
        ids_a, labels_a, of_a = anchors.value
        edge = edges.value
        n_slots = edge.shape[1] - 1
        tops = Tops(ids_a.size * n_slots, k)
        for batch in batches:
            ids, labels, of = _columns(batch)
            for lo, hi in _tiles(ids.size, ids_a.size):
                s = scores(of[lo:hi], of_a)
                least = np.maximum(edge[:, 1:] + 1, tops.worst.reshape(-1, n_slots)).astype(s.dtype)
                upper = edge.astype(s.dtype)
                for slot in range(n_slots):
                    r, a = np.nonzero((s >= least[:, slot]) & (s <= upper[:, slot]))
                    other = (labels[lo + r] != labels_a[a]) & (ids[lo + r] != ids_a[a])
                    r, a = r[other], a[other]
                    tops.offer(a * n_slots + slot, s[r, a].astype(np.int64), ids[lo + r])
        group, score, ids = tops.rows()
        yield pa.RecordBatch.from_arrays(
            [pa.array(group // n_slots), pa.array((group % n_slots).astype(np.int32)), pa.array(score), pa.array(ids)],
            names=["anchor", "slot", "score", "id"])
    return run


def _first(tops: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first ``k`` of each key by score, then id, with their place from 0."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return tops.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < k)


def _mine_block(rows: DataFrame, block: DataFrame, n_pos: int, n_neg: int, low: int, high: int) -> DataFrame:
    """All pairs of one block of anchors, whose vectors, labels and limits the driver holds."""
    spark = rows.sparkSession
    held = block.select("id", "label", "vector").toArrow().combine_chunks()
    ids_a, labels_a = (held.column(k).to_numpy().astype(np.int64) for k in (0, 1))
    anchors = ship(spark, (ids_a, labels_a, quantised(held.column(2).combine_chunks())))
    near = rows.mapInArrow(_best_of_label(anchors, n_pos), "anchor bigint, score bigint, id bigint")
    positives = written(_first(near, ["anchor"], n_pos), "positives")
    limits = np.full((ids_a.size, n_pos), _LEAST, np.int64)
    got = positives.select("anchor", "place", "score").toPandas()
    limits[got["anchor"], got["place"]] = got["score"]
    edges = ship(spark, slot_edges(limits, low, high))
    inside = rows.mapInArrow(_best_of_slots(anchors, edges, n_neg), "anchor bigint, slot int, score bigint, id bigint")
    found = (_first(inside, ["anchor", "slot"], n_neg)
             .groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("slot", "place", "score", "id"))).alias("found")))
    # slots descend, so the merge of a window's slots is the rest of the list from its own slot on
    below = F.slice(F.filter("found", lambda x: x["slot"] >= F.col("own")), 1, n_neg)
    inner = F.filter(below, lambda x: x["score"] * 100 >= F.col("positive_score") * low)
    names = spark.createDataFrame(pa.table({"anchor": pa.array(np.arange(ids_a.size)), "anchor_id": pa.array(ids_a)}))
    return (positives.select("anchor", F.col("place").alias("own"), F.col("id").alias("positive_id"),
                             F.col("score").alias("positive_score"))
            .join(found, "anchor").join(names, "anchor")
            .select("anchor_id", "positive_id", "positive_score", F.posexplode(inner).alias("at", "negative"))
            .select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"),
                    F.col("negative.id").alias("negative_id"), "positive_score",
                    F.col("negative.score").alias("negative_score")))


def mine(rows: DataFrame, anchor: Column, id: str = "vec_id", vector: str = "embedding", label: str | Column = "label",
         n_pos: int = POSITIVES, n_neg: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """Hard negatives of every row for which ``anchor`` holds, against all rows.

    One row (``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``) for each of the first
    ``n_neg`` rows of another label with ``low * positive <= 100 * negative <= high * positive``, for each of the
    anchor's first ``n_pos`` rows of its own label; nothing for a positive without such rows.  ``label`` is an integer
    column or expression, ``low < high`` are percents.
    """
    spark = rows.sparkSession
    label = F.col(label) if isinstance(label, str) else label
    finite = F.forall(F.col(vector), lambda x: F.coalesce(
        ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))), F.lit(False)))
    part = rows.where(F.col(id).isNotNull() & label.isNotNull() & F.coalesce(finite, F.lit(False)))
    used = part.select(F.col(id).cast("bigint").alias("id"), label.cast("bigint").alias("label"),
                       F.col(vector).alias("vector"))
    picked = written(part.where(anchor).select(F.col(id).cast("bigint").alias("id"), label.cast("bigint").alias("label"),
                                               F.col(vector).alias("vector")).distinct(), "anchors")
    n, width = picked.agg(F.count("*"), F.max(F.size("vector"))).first()
    most = max(1, min(BLOCK_ANCHORS, BLOCK_BYTES // (8 * max(1, width or 0))) // 2)
    n_blocks = -(-n // most)
    if not n_blocks:
        return spark.createDataFrame([], RESULT)
    block = F.pmod(F.xxhash64("id", "label", "vector"), F.lit(n_blocks))
    base = scratch_table_path(spark, f"llm-negatives-{uuid.uuid4().hex}")
    for k in range(n_blocks):
        _mine_block(used, picked.where(block == k), n_pos, n_neg, low, high).write.parquet(f"{base}/{k}")
    parts = [spark.read.schema(RESULT).parquet(f"{base}/{k}") for k in range(n_blocks)]
    return reduce(DataFrame.union, parts)


#: DuckDB SQL for the query's parameters: every window searched by itself over all pairs of anchor and row.
ORACLE = f"""
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id AS id,
         CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM (SELECT DISTINCT * FROM r WHERE vec_id % 50 = 0) a JOIN r ON r.vec_id <> a.vec_id),
p AS (
  SELECT anchor_id, id, score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
SELECT p.anchor_id, p.id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
       s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND {LOW} * p.score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.score
QUALIFY rank <= {NEGATIVES}"""
