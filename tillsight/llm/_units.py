"""Texts cut into units that a tokenizer encodes apart, each different unit worked once.

A unit starts with the space that leads the text or at a cut that a rule takes for safe, so a text with its space is
the concatenation of its units, and so is whatever is derived from them.  Cutting, finding the
different units and putting results together run over whole blocks of texts in arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked at once (a longer text is worked by itself).
BLOCK = 1 << 19
#: Different units remembered by a task before it starts anew.
LIMIT = 250_000
#: Spaces at the ends of a cut buffer: rules look at most three bytes back and one ahead.
PAD = 3


def cut(texts: list[bytes], rule: Callable) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The units of all texts, as a dictionary array, and the bounds of each text's units; empty texts have none.

    ``rule`` gives the places of safe cuts in a buffer that has ``PAD`` spaces at both ends.
    """
    sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
    ends = np.cumsum(sizes)
    whole = b"".join([b" " * PAD, *[b" " + t for t in texts if t], b" " * PAD])
    buf = np.frombuffer(whole, np.uint8)
    starts_unit = np.zeros(buf.size, bool)
    starts_unit[rule(buf)] = True
    starts_unit[(ends - sizes)[sizes > 0] + PAD] = True
    cuts = np.flatnonzero(starts_unit)
    offsets = np.append(cuts, buf.size - PAD)
    units = pa.Array.from_buffers(pa.large_binary(), cuts.size, [None, pa.py_buffer(offsets), pa.py_buffer(whole)])
    bounds = np.searchsorted(cuts, np.concatenate(([0], ends)) + PAD)
    return units.dictionary_encode(), bounds


class Memory:
    """What ``build`` makes of each different unit (a table, a row per unit), remembered between blocks."""

    def __init__(self, build: Callable[[list[bytes]], pa.Table], rule: Callable, limit: int = LIMIT):
        self.build, self.rule, self.limit = build, rule, limit
        self.known = pa.array([], pa.large_binary())
        self.table = build([])

    def of(self, texts: list[bytes]) -> tuple[pa.Table, np.ndarray]:
        """The rows of all units of the texts in order, and the bounds of each text's rows."""
        units, bounds = cut(texts, self.rule)
        if len(self.known) + len(units.dictionary) > self.limit:
            self.known, self.table = self.known.slice(0, 0), self.table.slice(0, 0)
        places = pc.index_in(units.dictionary, value_set=self.known)
        if places.null_count:
            new = units.dictionary.filter(places.is_null())
            self.table = pa.concat_tables([self.table, self.build(new.to_pylist())]).combine_chunks()
            places = places.fill_null(0).to_numpy().copy()
            places[pc.index_in(new, value_set=units.dictionary).to_numpy()] = len(self.known) + np.arange(len(new))
            self.known = pa.concat_arrays([self.known, new])
        else:
            places = places.to_numpy()
        return self.table.take(pa.array(places[units.indices.to_numpy()])), bounds


def in_slices(batches: Iterator[pa.RecordBatch], column: int, size: int = 4 * BLOCK) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into slices of about ``size`` bytes of the texts in ``column``: what a task holds at once
    follows from this, not from the length of the texts that share a batch."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(column)).fill_null(0)
        behind = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(behind, (behind[lo - 1] if lo else 0) + size, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def release() -> None:
    """Give freed Arrow memory back: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()


def blocks(texts: pa.Array) -> Iterator[list[bytes]]:
    """The texts in UTF-8 (null: empty), in blocks of about ``BLOCK`` bytes."""
    whole = pa.RecordBatch.from_arrays([texts], names=["text"])
    for part in in_slices(iter([whole]), 0, BLOCK):
        yield [t or b"" for t in part.column(0).cast(pa.large_binary()).to_pylist()]


def by_unit(rows: pa.Array, bounds: np.ndarray) -> pa.Array:
    """Binary rows joined unit by unit, given the bounds of each unit's rows."""
    offsets = np.frombuffer(rows.buffers()[1], np.int64)[rows.offset:rows.offset + len(rows) + 1]
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1,
                                 [None, pa.py_buffer(offsets[bounds].copy()), rows.buffers()[2]])


def flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of all rows of a list column in a row, and the n + 1 bounds of the rows."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))))
    return lists.flatten().to_numpy(), sizes


def joined(column: pa.ChunkedArray) -> tuple[memoryview, np.ndarray]:
    """Bytes of all rows of a binary column in a row, and the n + 1 bounds of the rows."""
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(rows):
        return memoryview(b""), np.zeros(1, np.int64)
    offsets = np.frombuffer(rows.buffers()[1], np.int64)[rows.offset:rows.offset + len(rows) + 1]
    return memoryview(rows.buffers()[2])[offsets[0]:offsets[-1]], offsets - offsets[0]
