"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of words.

Words are lower-case runs of letters and digits, so case and punctuation don't hide a copy.
1. One pass emits the passages around places where an n-gram of any item stands (as word hashes).  They give every
   n-gram its document frequency.
2. An item's seeds are its rare n-grams.  In each stretch of ``STRETCH`` n-grams the most frequent one is left out if
   ``COMMON`` passages or more hold it, and so are, up to half of the stretch, those that stand in ``SHARED`` or more
   different items.  No more is left out, since the n-grams that an edited version leaves whole are as frequent as that
   version is: every version that leaves two n-grams of a stretch whole, outside phrases of many items, has a seed.
3. Hits of seeds give windows of the passages in which the item may lie.  A window that holds too few of the item's
   words to reach the threshold is set aside (its score can't pass the words it shares).  All others
   are aligned (match 2, mismatch and gap -1).  The score is the best local alignment divided by the item's perfect
   score; 1.0 is an exact copy.

The pass tests n-grams against a bitmap whose size follows the items' n-grams, up to ``MOST_BITS``; the join makes that
exact.  No side is broadcast by hand.  Items with fewer than ``N`` words have no n-gram and are
never found; null and empty texts have none either.  Documents and items are told apart by id and text, so
rows without an id are reported like any other, two texts under one id are searched each, and equal rows
count as one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillsight.llm._tables import bitmap, in_bitmap, ship, written
from tillsight.llm._units import in_slices
from tillsight.llm._words import hash_runs, join_texts, shingles

N = 3
BITS, MOST_BITS = 23, 27  # of the bitmap of n-grams: 1 to 16 MB
MATCH, MISS, GAP = 2, -1, -1
THRESHOLD = 0.5
STRETCH, COMMON, SHARED = 16, 32, 8

_KIND = np.zeros(256, dtype=np.uint8)
_FOLD = np.arange(256, dtype=np.uint8)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _KIND[_a:_b] = 1
_FOLD[65:91] += 32


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and the n + 1 bounds of each text's words."""
    buf, text_starts = join_texts(texts)
    starts, hashes = hash_runs(buf, _KIND, _FOLD)
    return hashes, np.searchsorted(starts, text_starts)


def _short(hashes: np.ndarray) -> pa.Array:
    return pa.array((hashes >> np.uint64(32)).astype(np.uint32).view(np.int32))


def _named(rows: DataFrame, key: str, text: str, name: str, number: str) -> DataFrame:
    """``name`` (the id), ``number`` (a hash of id and text) and ``text``, in lower case in all alphabets."""
    return rows.select(F.col(key).alias(name), F.xxhash64(F.col(key), F.col(text)).alias(number),
                       F.lower(F.col(text)).alias("text"))


def item_words(items: DataFrame, key: str, text: str) -> DataFrame:
    """``item``, ``number``, ``words`` (array<int>), ``grams`` (array<bigint>) of every item with an n-gram."""
    def run(batches):
        for batch in batches:
            words, bounds = word_hashes(batch.column(2))
            rows = [i for i in range(batch.num_rows) if bounds[i + 1] - bounds[i] >= N]
            parts = [words[bounds[i]:bounds[i + 1]] for i in rows]
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(at), batch.column(1).take(at),
                pa.array([_short(p).to_pylist() for p in parts], pa.list_(pa.int32())),
                pa.array([shingles(p, N).view(np.int64).tolist() for p in parts], pa.list_(pa.int64()))],
                names=["item", "number", "words", "grams"])

    kind = items.schema[key].dataType.simpleString()
    return _named(items, key, text, "item", "number").distinct().mapInArrow(
        run, f"item {kind}, number bigint, words array<int>, grams array<bigint>")


def choose_seeds(bench: DataFrame, found: DataFrame) -> DataFrame:
    """``gram``, ``number`` (of the item), ``m`` (its words) and ``offset`` of the items' rare n-grams."""
    grams = bench.select("number", F.size("words").alias("m"), F.posexplode("grams").alias("offset", "gram"))
    held = found.select(F.explode(F.array_distinct("hits.gram")).alias("gram")).groupBy("gram").agg(
        F.count(F.lit(1)).alias("df"))
    shared = bench.select("words", F.explode(F.array_distinct("grams")).alias("gram")).distinct().groupBy("gram").agg(
        F.count(F.lit(1)).alias("n_items"))
    stretch = ["number", "stretch"]
    size = F.count(F.lit(1)).over(Window.partitionBy(*stretch))
    frequent = F.row_number().over(Window.partitionBy(*stretch).orderBy(F.desc("df"), "gram", "offset"))
    widest = F.row_number().over(Window.partitionBy(*stretch).orderBy(F.desc("n_items"), "gram", "offset"))
    ranked = (grams.withColumn("stretch", F.floor(F.col("offset") / STRETCH)).withColumn("size", size)
              .join(held, "gram").join(shared, "gram")
              .withColumn("frequent", frequent).withColumn("widest", widest))
    common = (F.col("frequent") == 1) & (F.col("df") >= COMMON) & (F.col("size") > 2)
    template = (F.col("n_items") >= SHARED) & (F.col("widest") <= F.col("size") / 2)
    return ranked.where(~common & ~template).select("gram", "number", "m", "offset")


def _hits(words: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of a text's n-grams that may belong to an item."""
    if words.size < N:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = shingles(words, N).view(np.int64)
    at = np.flatnonzero(in_bitmap(bits, grams))
    return at, grams[at]


def passages(docs: DataFrame, key: str, text: str, bits: np.ndarray, radius: int) -> DataFrame:
    """``doc``, ``text_no``, ``start``, ``words``, ``hits`` (place, gram): stretches within ``radius`` words of a hit."""
    held = ship(docs.sparkSession, bits)

    def run(batches):
        for batch in in_slices(batches, 2):
            words, bounds = word_hashes(batch.column(2))
            rows, starts, texts, hits = [], [], [], []
            for i in range(batch.num_rows):
                part = words[bounds[i]:bounds[i + 1]]
                at, gram = _hits(part, held.value)
                if not at.size:
                    continue
                cut = np.flatnonzero(np.diff(at) > 2 * radius + N) + 1
                for a, g in zip(np.split(at, cut), np.split(gram, cut)):
                    lo, hi = max(0, int(a[0]) - radius), min(part.size, int(a[-1]) + N + radius)
                    rows.append(i)
                    starts.append(lo)
                    texts.append(_short(part[lo:hi]))
                    hits.append([{"at": x, "gram": y} for x, y in zip(a.tolist(), g.tolist())])
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(at), batch.column(1).take(at), pa.array(starts, pa.int64()),
                pa.array([t.to_pylist() for t in texts], pa.list_(pa.int32())),
                pa.array(hits, pa.list_(pa.struct([("at", pa.int64()), ("gram", pa.int64())])))],
                names=["doc", "text_no", "start", "words", "hits"])

    kind = docs.schema[key].dataType.simpleString()
    return _named(docs, key, text, "doc", "text_no").mapInArrow(
        run, f"doc {kind}, text_no bigint, start bigint, words array<int>, hits array<struct<at: bigint, gram: bigint>>")


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> np.ndarray:
    """Best local alignment score of each pair, all pairs at once, one item word at a time."""
    if not items:
        return np.zeros(0, np.int32)
    m, w = max(map(len, items)), max(max(map(len, windows)), 1)
    a = np.zeros((len(items), m), np.int64)
    b = np.zeros((len(items), w), np.int64)
    a_len, b_len = np.array([len(x) for x in items]), np.array([len(x) for x in windows])
    for k, (x, y) in enumerate(zip(items, windows)):
        a[k, :len(x)], b[k, :len(y)] = x, y
    beyond = np.arange(w)[None, :] >= b_len[:, None]
    step = np.arange(w + 1, dtype=np.int32) * -GAP
    row = np.zeros((len(items), w + 1), np.int32)
    best = np.zeros(len(items), np.int32)
    for j in range(m):
        new = np.zeros_like(row)
        new[:, 1:] = np.maximum(row[:, :-1] + np.where((a[:, j:j + 1] == b) & ~beyond, MATCH, MISS), row[:, 1:] + GAP)
        np.maximum(new, 0, out=new)
        # gaps along the window: a running maximum after removing each place's gap cost
        new = np.maximum.accumulate(new + step, axis=1) - step
        new[j >= a_len] = 0
        row = new
        best = np.maximum(best, row.max(axis=1))
    return best


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Pair and word of every word of a list column, as one key."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    pair = np.repeat(np.arange(len(sizes)), sizes)
    return pair, pair << 32 | (column.flatten().to_numpy().astype(np.int64) & 0xFFFFFFFF)


def hopeful(items: pa.Array, windows: pa.Array, threshold: float) -> np.ndarray:
    """Pairs whose window holds so many of the item's words that the score can reach ``threshold``."""
    pair, words = _flat(items)
    shared = np.bincount(pair[np.isin(words, _flat(windows)[1])], minlength=len(items))
    return np.flatnonzero(shared >= threshold * items.value_lengths().to_numpy(zero_copy_only=False) - 1e-9)


def _scores(threshold: float):
    def run(batches):
        for batch in batches:
            batch = batch.take(pa.array(hopeful(batch.column("item_words"), batch.column("window"), threshold)))
            items = [np.asarray(x.values, np.int64) for x in batch.column("item_words")]
            windows = [np.asarray(x.values, np.int64) for x in batch.column("window")]
            order = sorted(range(len(items)), key=lambda k: (len(items[k]), len(windows[k])))
            score = np.zeros(len(items))
            lo = 0
            while lo < len(order):  # pairs of like size together, some hundred thousand cells at a time
                hi, cells = lo, 0
                while hi < len(order) and (hi == lo or cells < 400_000):
                    cells += len(windows[order[hi]]) + 1
                    hi += 1
                part = order[lo:hi]
                got = align([items[k] for k in part], [windows[k] for k in part])
                score[part] = got / np.array([MATCH * len(items[k]) for k in part])
                lo = hi
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("item"), pa.array(score),
                                              batch.column("n_words"), batch.column("first_word")],
                                             names=["doc", "item", "score", "n_words", "first_word"])
    return run


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                 item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``key``, ``item_key``, ``score``, ``item_words``, ``first_word`` of every document that holds an item.

    One row per pair whose best alignment reaches ``threshold``; ``first_word`` is where the
    best window starts in the document (from 0).  Other columns of both tables are not read.
    """
    bench = written(item_words(items, item_key, item_text), "decontam-items")
    grams = bench.select(F.explode("grams").alias("gram"))
    bits = min(MOST_BITS, max(BITS, (16 * grams.count()).bit_length()))  # one in sixteen set, as far as it may grow
    longest = bench.agg(F.max(F.size("words"))).first()[0] or 0
    found = written(passages(docs, key, text, bitmap(grams, F.col("gram"), bits), 3 * longest), "decontam-passages")
    seeds = choose_seeds(bench, found)
    passage = ["text_no", "start"]
    hits = found.select(*passage, F.explode("hits").alias("h")).select(*passage, "h.at", "h.gram")
    # the item would start at word at - offset; windows begin at multiples of the item's length
    lead = F.floor((F.col("at") - F.col("offset")) / F.col("m")) * F.col("m")
    slack = F.floor(F.col("m") / 4)
    windows = (hits.join(seeds, "gram")
               .select(*passage, "number", F.greatest(F.col("start"), lead - slack).alias("first_word"),
                       (lead + 2 * F.col("m") + slack).alias("end")).distinct())
    once = bench.select("number", "item", F.col("words").alias("item_words"), F.size("words").alias("n_words"))
    pairs = (windows.join(found.select(*passage, "doc", "words").dropDuplicates(passage), passage)
             .select("doc", "number", "first_word",
                     F.slice("words", (F.col("first_word") - F.col("start") + 1).cast("int"),
                             (F.col("end") - F.col("first_word")).cast("int")).alias("window"))
             .join(once, "number").drop("number"))
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    scored = pairs.mapInArrow(_scores(threshold), f"doc {kinds['doc']}, item {kinds['item']}, score double, n_words int, "
                                                  "first_word bigint")
    best = scored.where(F.col("score") >= threshold).groupBy("doc", "item").agg(
        F.max(F.struct(F.col("score"), (-F.col("first_word")).alias("back"))).alias("b"), F.max("n_words").alias("n"))
    return best.select(F.col("doc").alias(key), F.col("item").alias(item_key), F.col("b.score").alias("score"),
                       F.col("n").alias("item_words"), (-F.col("b.back")).alias("first_word"))
