"""Alignment of two tokenizers' tokens of the same text, by products of sparse incidence matrices.

Both tokenizers split the bytes of space + text.  Three matrices in CSR form, built by hand:
the token-byte incidences A and B (a row per token, a column per byte of a block of texts) and the
group incidences (a column per group).  Offsets at which tokens of both sides end cut the tokens into groups.

* ``A · Bᵀ`` by Gustavson's row products gives the overlap links, valued with the shared bytes;
  those whose last bytes coincide are the links that end together.
* ``Gᴬ · Gᴮᵀ`` gives the shared-group links.

Where both tokenizers end a token whatever stands around it, texts are cut into units: common
ends, which no group or link crosses.  Each different unit is encoded and multiplied once, and
a text's result is put together from its units' in arrays.

``align`` returns ids, groups and links of every text; ``link_statistics`` adds how often the linked id pairs occur in
the whole corpus.  Two tokens that end together are suffixes of one another, so the id pairs that can be
linked follow from the vocabularies (``linkable``): their counts have a size fixed by the two tokenizers, whatever
the corpus, and are the only thing that is gathered and broadcast.

Texts that are null or empty, or that a tokenizer doesn't keep byte for byte, have no tokens.  Repeated rows and
rows without an id are aligned like any other.  Input columns named like an added one are replaced.
"""

from __future__ import annotations

import hashlib
import os
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.llm import sp_bpe
from tillsight.llm._tables import ship, written
from tillsight.llm._units import PAD, Memory, blocks, flat, joined, release

SPACE = "▁"
#: Classes of bytes: not ASCII, white space or control, space, line feed, digit, letter, apostrophe, other sign.
_OTHER, _CONTROL, _SPACE, _FEED, _DIGIT, _LETTER, _QUOTE, _SIGN = range(8)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[:128] = [_CONTROL if c <= 32 or c == 127 else _DIGIT if chr(c).isdigit() else _LETTER if chr(c).isalpha() else _SIGN
                for c in range(128)]
_CLASS[[32, 10, 39]] = _SPACE, _FEED, _QUOTE
_WIDE = np.isin(np.arange(256), [0xE1, 0xE2, 0xE3])
#: Nonzeros multiplied at once.
BLOCK = 1 << 18
#: Units handed to the byte-level tokenizer at once (what it returns is many times larger than the ids), and rows summed.
AT_ONCE = 1 << 11
LINKS = ("overlap", "end", "group")


class Csr:
    """A sparse matrix of counts: row ``i`` has the columns ``indices[indptr[i]:indptr[i + 1]]``."""

    def __init__(self, indptr: np.ndarray, indices: np.ndarray, n_cols: int, data: np.ndarray | None = None):
        self.indptr, self.indices, self.n_cols, self.data = indptr, indices, n_cols, data

    @property
    def n_rows(self) -> int:
        return len(self.indptr) - 1

    def rows(self) -> np.ndarray:
        """The row of every nonzero."""
        return np.repeat(np.arange(self.n_rows), np.diff(self.indptr))

    def transposed(self) -> Csr:
        order = np.argsort(self.indices, kind="stable")
        indptr = np.zeros(self.n_cols + 1, np.int64)
        np.cumsum(np.bincount(self.indices, minlength=self.n_cols), out=indptr[1:])
        return Csr(indptr, self.rows()[order], self.n_rows, None if self.data is None else self.data[order])

    def times(self, other: Csr, block: int = BLOCK) -> Csr:
        """The product by Gustavson's method: row i is the sum of the rows of ``other`` that row i names.

        Rows are worked in blocks of about ``block`` nonzeros, so that the expanded rows stay bounded.
        """
        rows, cols, data = [], [], []
        lo = 0
        while lo < self.n_rows:
            hi = max(lo + 1, int(np.searchsorted(self.indptr, self.indptr[lo] + block, "right")) - 1)
            part = slice(self.indptr[lo], self.indptr[hi])
            named = self.indices[part]
            counts = other.indptr[named + 1] - other.indptr[named]
            ends = np.cumsum(counts)
            total = int(ends[-1]) if counts.size else 0
            at = np.arange(total) + np.repeat(other.indptr[named] - (ends - counts), counts)
            i = np.repeat(np.repeat(np.arange(lo, hi), np.diff(self.indptr[lo:hi + 1])), counts)
            j = other.indices[at]
            value = np.ones(total, np.int64) if self.data is None else np.repeat(self.data[part], counts)
            if other.data is not None:
                value = value * other.data[at]
            key = i * other.n_cols + j
            if total and (np.diff(key) < 0).any():
                order = np.argsort(key, kind="stable")
                key, value, i, j = key[order], value[order], i[order], j[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            if first.size:
                rows.append(i[first])
                cols.append(j[first])
                data.append(np.add.reduceat(value, first))
            lo = hi
        i, j, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, cols, data))
        indptr = np.zeros(self.n_rows + 1, np.int64)
        np.cumsum(np.bincount(i, minlength=self.n_rows), out=indptr[1:])
        return Csr(indptr, j, other.n_cols, v)


def token_bytes(lengths: np.ndarray, n_bytes: int) -> Csr:
    """Incidence of consecutive tokens and the bytes that they cover."""
    return Csr(np.concatenate(([0], np.cumsum(lengths))), np.arange(n_bytes), n_bytes)


def token_groups(group: np.ndarray, n_groups: int) -> Csr:
    """Incidence of tokens and their group."""
    return Csr(np.arange(group.size + 1), group, n_groups)


def _byte_alphabet() -> dict[str, int]:
    """Character to byte of byte-level vocabularies: printable bytes stand for themselves, the others follow at 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Side:
    """One tokenizer: its ids of texts, and the bytes of every id."""

    def __init__(self, token_bytes_of: list[bytes]):
        self.bytes_of = token_bytes_of
        self.length = np.array([len(b) for b in token_bytes_of], np.int64)
        self.table = pa.array(token_bytes_of, pa.large_binary())

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all tokens in a row."""
        got = self.table.take(pa.array(ids))
        offsets = np.frombuffer(got.buffers()[1], np.int64)[got.offset:got.offset + len(got) + 1]
        data = got.buffers()[2]
        return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)


class ByteLevel(Side):
    """A byte-level BPE; strings of special tokens are plain text, and a space leads every text."""

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on every core
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(file)
        self.model.encode_special_tokens = True
        byte = _byte_alphabet()
        vocab = self.model.get_vocab()
        of = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            of[i] = bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode()
        super().__init__(of)

    def encode(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        encoded: list[list[int]] = []
        for lo in range(0, len(units), AT_ONCE):
            part = [u.decode() for u in units[lo:lo + AT_ONCE]]
            encoded += [e.ids for e in self.model.encode_batch_fast(part, add_special_tokens=False)]
        sizes = np.array([len(x) for x in encoded], np.int64)
        return np.fromiter(chain.from_iterable(encoded), np.int64, int(sizes.sum())), sizes

    @staticmethod
    def cuts(buf: np.ndarray) -> np.ndarray:
        """Whether the pattern that splits texts ends a part before each byte, whatever stands on either side.

        It does between runs of letters, digits and other signs, before white space, and behind a single line
        feed.  An apostrophe may belong to the letters behind it.  Only ASCII characters are judged, and before
        a space characters of the UTF-8 rows other than C2, E1, E2 and E3, which hold all other white space.
        """
        here, last = _CLASS[buf[PAD:-PAD]], _CLASS[buf[PAD - 1:-PAD - 1]]
        sign = (last != here) & (last >= _DIGIT) & (here >= _DIGIT) & (last != _QUOTE)
        sign &= ~((last == _SIGN) & (here == _QUOTE))
        behind = (buf[PAD - 2:-PAD - 2] == 0xC2) | _WIDE[buf[PAD - 3:-PAD - 3]]
        solid = (last >= _DIGIT) | (last == _OTHER) & ~behind
        feed = (last == _FEED) & (here >= _DIGIT) & (_CLASS[buf[PAD - 2:-PAD - 2]] >= _DIGIT)
        return sign | solid & ((here == _SPACE) | (here == _FEED)) | feed


class Pieces(Side):
    """A SentencePiece BPE model that puts the leading space itself."""

    def __init__(self, file: str):
        self.model = m = sp_bpe.load(file)
        super().__init__([bytes([m.byte_of[i]]) if i in m.byte_of else p.replace(SPACE, " ").encode()
                          for i, p in enumerate(m.pieces)])

    def encode(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = self.model.encode_units(units)
        return ids.astype(np.int64), sizes


_sides: dict[tuple[type, str], Side] = {}


def side(kind: type, file: str) -> Side:
    """A tokenizer, loaded once in a Python process."""
    if (kind, file) not in _sides:
        _sides[kind, file] = kind(file)
    return _sides[kind, file]


def linkable(a: Side, b: Side) -> np.ndarray:
    """Sorted keys (A id << 32 | B id) of the pairs of which one token's bytes end with the other's.

    Only these can end together; there are at most as many as the bytes of all tokens (and of namesakes).
    """
    def having(s: Side) -> dict[bytes, list[int]]:
        ids: dict[bytes, list[int]] = {}
        for i, token in enumerate(s.bytes_of):
            ids.setdefault(token, []).append(i)
        return ids

    of_a, of_b = having(a), having(b)
    keys = [i << 32 | j for i, t in enumerate(a.bytes_of) for k in range(len(t)) for j in of_b.get(t[k:], ())]
    keys += [i << 32 | j for j, t in enumerate(b.bytes_of) for k in range(len(t)) for i in of_a.get(t[k:], ())]
    return np.unique(np.array(keys, np.int64))


def cuts(a: Side, b: Side):
    """The rule that cuts a buffer where both tokenizers end a token, whatever stands on either side."""
    def rule(buf: np.ndarray) -> np.ndarray:
        at = b.model.cuts(buf)
        return at[a.cuts(buf)[at - PAD]]
    return rule


def _bounds(counts: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(counts)))


class Block:
    """Tokens, groups and links of units of text; a unit that isn't kept byte for byte has none."""

    def __init__(self, units: list[bytes], a: Side, b: Side):
        self.a_ids, self.a_counts = a.encode(units)
        self.b_ids, self.b_counts = b.encode(units)
        self.kept = self._same(a, self.a_ids, self.a_counts, units) & self._same(b, self.b_ids, self.b_counts, units)
        if not self.kept.all():
            self.a_ids, self.a_counts = self.a_ids[np.repeat(self.kept, self.a_counts)], self.a_counts * self.kept
            self.b_ids, self.b_counts = self.b_ids[np.repeat(self.kept, self.b_counts)], self.b_counts * self.kept
        self.n_bytes = int(sum(len(u) for u, s in zip(units, self.kept) if s))
        self.a_length, self.b_length = a.length[self.a_ids], b.length[self.b_ids]
        self.a_end, self.b_end = np.cumsum(self.a_length), np.cumsum(self.b_length)
        overlap = token_bytes(self.a_length, self.n_bytes).times(
            token_bytes(self.b_length, self.n_bytes).transposed())
        self.link_a, self.link_b, self.link_bytes = overlap.rows(), overlap.indices, overlap.data
        self.ends = self.a_end[self.link_a] == self.b_end[self.link_b]
        # a common end closes a group: every token's group is the number of groups closed before it
        closes_a, closes_b = (np.zeros(x.size, bool) for x in (self.a_ids, self.b_ids))
        closes_a[self.link_a[self.ends]] = True
        closes_b[self.link_b[self.ends]] = True
        self.closes_a, self.closes_b = closes_a, closes_b
        self.group_a = np.cumsum(closes_a) - closes_a
        self.group_b = np.cumsum(closes_b) - closes_b
        self.n_groups = np.diff(_bounds(closes_a)[_bounds(self.a_counts)])

    @staticmethod
    def _same(s: Side, ids: np.ndarray, counts: np.ndarray, raw: list[bytes]) -> np.ndarray:
        """Whether the tokens of a text join to its bytes."""
        joined, whole = s.joined(ids), np.frombuffer(b"".join(raw), np.uint8)
        have = _bounds(s.length[ids])[_bounds(counts)]
        want = _bounds(np.array([len(r) for r in raw], np.int64))
        if np.array_equal(have, want) and np.array_equal(joined, whole):
            return np.ones(len(raw), bool)
        return np.array([joined[have[k]:have[k + 1]].tobytes() == r for k, r in enumerate(raw)], bool)

    def links(self, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token of A, token of B and shared bytes (``group``: 1) of every link, by A, then B."""
        if kind == "group":
            n = int(self.closes_a.sum())
            got = token_groups(self.group_a, n).times(token_groups(self.group_b, n).transposed())
            return got.rows(), got.indices, got.data
        pick = self.ends if kind == "end" else slice(None)
        return self.link_a[pick], self.link_b[pick], self.link_bytes[pick]

    def group_texts(self, texts_of: pa.Array) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3;`` of every unit; ``texts_of`` has each id with ',', '|' and ';' behind it."""
        up_to_a, up_to_b = (np.concatenate(([0], np.flatnonzero(c) + 1)) for c in (self.closes_a, self.closes_b))
        shown = np.zeros(self.a_ids.size + self.b_ids.size, np.int64)
        # a token of A stands behind B's tokens of earlier groups, one of B behind A's of its own group too
        shown[np.arange(self.a_ids.size) + up_to_b[self.group_a]] = 3 * self.a_ids + self.closes_a
        shown[np.arange(self.b_ids.size) + up_to_a[self.group_b + 1]] = 3 * self.b_ids + 2 * self.closes_b
        got = texts_of.take(pa.array(shown))
        offsets = np.frombuffer(got.buffers()[1], np.int64)[got.offset:got.offset + len(got) + 1]
        data = memoryview(got.buffers()[2]) if shown.size else memoryview(b"")
        edge = offsets[_bounds(self.a_counts + self.b_counts)]
        return [bytes(data[s:e]) for s, e in zip(edge[:-1], edge[1:])]


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(_bounds(counts).astype(np.int32)), pa.array(values.astype(np.int32)))


def _of_unit(units: list[bytes], a: Side, b: Side, links: str) -> tuple[Block, np.ndarray, np.ndarray, list]:
    """The block of the units, its links, and the number of links of each unit."""
    block = Block(units, a, b)
    found = block.links(links)
    unit = np.searchsorted(_bounds(block.a_counts), found[0], "right") - 1
    return block, unit, np.bincount(unit, minlength=len(units)), found


def _mapped(docs: DataFrame, text: str, added: dict[str, str], a_file: str, b_file: str, build, columns,
            keep_text: bool = True) -> DataFrame:
    """``docs``, without the text if it isn't kept, with the columns that ``columns(rows, bounds)`` gives for a block of texts.

    ``rows`` is what ``build`` made of each unit of the texts, without the units of texts that have one that
    isn't ``kept``; ``bounds`` are the bounds of each text's rows.
    """
    left = docs.select(*[f"`{c}`" for c in docs.columns if c == text or c not in added])
    handed_on = [f for f in left.schema.fields if keep_text or f.name != text]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in handed_on] + [f"{n} {t}" for n, t in added.items()])
    names = [f.name for f in handed_on]
    types = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}

    def run(batches):
        memory = Memory(build, cuts(side(ByteLevel, a_file), side(Pieces, b_file)))
        for batch in batches:
            parts = []
            for texts in blocks(batch.column(batch.schema.get_field_index(text))):
                rows, bounds = memory.of(texts)
                lost = _bounds(~rows["kept"].to_numpy())[bounds]
                if lost[-1]:
                    whole = np.diff(lost) == 0
                    counts = np.diff(bounds)
                    rows, bounds = rows.filter(pa.array(np.repeat(whole, counts))), _bounds(counts * whole)
                parts.append(columns(rows, bounds))
            cols = [pa.concat_arrays([p[k].cast(types[t]) for p in parts]) if parts else pa.array([], types[t])
                    for k, t in enumerate(added.values())]
            held = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*held, *cols], names=[*names, *added])
            del parts, cols, held
            release()
        del memory
        release()

    return left.mapInArrow(run, schema)


def _sums(column: pa.ChunkedArray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(_bounds(column.to_numpy())[bounds])


def align(docs: DataFrame, a_file: str, b_file: str, text: str = "text", links: str = "overlap") -> DataFrame:
    """Add the tokens, groups and links of every whole text.

    ``a_ids`` and ``b_ids``; ``a_groups`` and ``b_groups``, the group (from 0) of each token; ``link_a``, ``link_b``
    (places in the id arrays) and ``link_bytes`` of the links: ``overlap`` (shared bytes), ``end`` (last bytes
    coincide) or ``group`` (same group; bytes 1).  No shuffle.
    """
    if links not in LINKS:
        raise ValueError(f"links must be one of {LINKS}")
    added = dict.fromkeys(["a_ids", "b_ids", "a_groups", "b_groups", "link_a", "link_b", "link_bytes"], "array<int>")

    def build(units: list[bytes]) -> pa.Table:
        block, unit, n_links, (link_a, link_b, shared) = _of_unit(
            units, side(ByteLevel, a_file), side(Pieces, b_file), links)
        at_a, at_b, groups = (_bounds(c)[:-1] for c in (block.a_counts, block.b_counts, block.n_groups))
        cols = {"a_ids": (block.a_ids, block.a_counts), "b_ids": (block.b_ids, block.b_counts),
                "a_groups": (block.group_a - np.repeat(groups, block.a_counts), block.a_counts),
                "b_groups": (block.group_b - np.repeat(groups, block.b_counts), block.b_counts),
                "link_a": (link_a - at_a[unit], n_links), "link_b": (link_b - at_b[unit], n_links),
                "link_bytes": (shared, n_links)}
        return pa.table({n: _lists(*c) for n, c in cols.items()}
                        | {"kept": pa.array(block.kept, pa.bool_()), "n_groups": pa.array(block.n_groups, pa.int64())})

    def columns(rows: pa.Table, bounds: np.ndarray) -> list[pa.Array]:
        values, edges = {}, {}
        for name in added:
            values[name], edges[name] = flat(rows[name])
        # a unit's places and groups go on from those of the text's units before it
        before = {"a_ids": edges["a_ids"][:-1], "b_ids": edges["b_ids"][:-1],
                  "groups": _bounds(rows["n_groups"].to_numpy())[:-1]}
        first = np.repeat(bounds[:-1], np.diff(bounds))
        for name, of in (("a_groups", "groups"), ("b_groups", "groups"), ("link_a", "a_ids"), ("link_b", "b_ids")):
            shift = before[of] - before[of][first]
            values[name] = values[name] + np.repeat(shift, np.diff(edges[name]))
        return [_lists(values[n], np.diff(edges[n][bounds])) for n in added]

    return _mapped(docs, text, added, a_file, b_file, build, columns)


def _digests(docs: DataFrame, a_file: str, b_file: str, text: str, pairs) -> DataFrame:
    """Per text: token, group and link counts, the digest of its groups, and its end links as places in ``pairs.value`` (bytes of 32-bit numbers)."""
    added = {"n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint",
             "groups_sha256": "string", "pairs": "binary"}

    def build(units: list[bytes]) -> pa.Table:
        a, b = side(ByteLevel, a_file), side(Pieces, b_file)
        block, _, n_links, (link_a, link_b, _) = _of_unit(units, a, b, "end")
        at = np.searchsorted(pairs.value, block.a_ids[link_a] << 32 | block.b_ids[link_b])
        shown = block.group_texts(_shown(max(len(a.bytes_of), len(b.bytes_of))))
        return pa.table({
            "n_a": pa.array(block.a_counts, pa.int64()), "n_b": pa.array(block.b_counts, pa.int64()),
            "n_groups": pa.array(block.n_groups, pa.int64()), "n_links": pa.array(n_links, pa.int64()),
            "shown": pa.array(shown, pa.large_binary()), "pairs": _lists(at, n_links),
            "kept": pa.array(block.kept, pa.bool_())})

    def columns(rows: pa.Table, bounds: np.ndarray) -> list[pa.Array]:
        data, edge = joined(rows["shown"])
        edge = edge[bounds]
        digest = [hashlib.sha256(data[s:e - 1]).hexdigest() if e > s else "" for s, e in zip(edge[:-1], edge[1:])]
        at, starts = flat(rows["pairs"])
        pairs_of = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [
            None, pa.py_buffer(4 * starts[bounds]), pa.py_buffer(np.ascontiguousarray(at, dtype=np.int32))])
        return [*[pa.array(_sums(rows[c], bounds)) for c in ("n_a", "n_b", "n_groups", "n_links")],
                pa.array(digest, pa.string()), pairs_of]

    return _mapped(docs, text, added, a_file, b_file, build, columns, keep_text=False)


_tables: dict[int, pa.Array] = {}


def _shown(n: int) -> pa.Array:
    """Ids 0 to n - 1 in decimal, each with ',', '|' and ';' behind it."""
    if n not in _tables:
        _tables[n] = pa.array([f"{i}{c}" for i in range(n) for c in ",|;"], pa.large_string())
    return _tables[n]


def _pairs_in(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows of a binary column in a row, and the n + 1 bounds of the rows."""
    data, edge = joined(column.cast(pa.large_binary()))
    return np.frombuffer(data, np.int32), edge // 4


def pair_counts(aligned: DataFrame, n_pairs: int) -> np.ndarray:
    """How many links of the corpus hold each pair; summed within tasks first, at most ``n_pairs`` rows from each."""
    def run(batches):
        seen = np.zeros(n_pairs, np.int64)
        for batch in batches:
            seen += np.bincount(_pairs_in(batch.column(0))[0], minlength=n_pairs)
        pair = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int32)), pa.array(seen[pair])], names=["pair", "n"])

    got = aligned.select("pairs").mapInArrow(run, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    rows = got.toPandas()
    counts = np.zeros(n_pairs, np.int64)
    counts[rows["pair"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return counts


def link_statistics(docs: DataFrame, a_file: str, b_file: str, text: str = "text") -> DataFrame:
    """Alignment digests of every text with the corpus-wide counts of its links that end together.

    Adds ``n_a``, ``n_b`` (tokens), ``n_groups``, ``n_links``, ``n_best`` (links whose pair is as frequent as any with the
    same B id), ``count_sum`` (sum of the links' counts) and ``groups_sha256`` (empty without tokens), and
    drops the text.  The texts are encoded once: ids of linked pairs are written beside the
    digests and read for the counts and for the sums.
    """
    a, b = side(ByteLevel, a_file), side(Pieces, b_file)
    pairs = linkable(a, b)
    aligned = written(_digests(docs, a_file, b_file, text, ship(docs.sparkSession, pairs)), "aligned", codec="zstd")
    counts = pair_counts(aligned, pairs.size)
    of_b = pairs & 0xFFFFFFFF
    highest = np.zeros(len(b.bytes_of), np.int64)
    np.maximum.at(highest, of_b, counts)
    known = ship(docs.sparkSession, (counts, counts == highest[of_b]))
    names = [c for c in aligned.columns if c not in ("pairs", "groups_sha256")]
    kept = aligned.select(*[f"`{c}`" for c in [*names, "groups_sha256", "pairs"]])
    schema = ", ".join([f"`{c}` {aligned.schema[c].dataType.simpleString()}" for c in names]
                       + ["n_best bigint", "count_sum bigint", "groups_sha256 string"])

    def sums(batches):
        of, best = known.value
        for batch in (b.slice(lo, AT_ONCE) for b in batches for lo in range(0, b.num_rows, AT_ONCE)):
            pairs, edge = _pairs_in(batch.column(batch.num_columns - 1))
            total = [np.diff(_bounds(v[pairs].astype(np.int64))[edge]) for v in (best, of)]
            cols = [*batch.columns[:-2], *map(pa.array, total), batch.column(batch.num_columns - 2)]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "n_best", "count_sum", "groups_sha256"])

    return kept.mapInArrow(sums, schema)
