"""Byte-pair encoding with a SentencePiece BPE vocabulary, as vectorised merge rounds.

``Bpe`` reads pieces and scores of a model with the identity normaliser and a dummy prefix
(space becomes U+2581) and byte fallback.  ``encode_units`` holds the symbols of many units
of text in one flat array and repeats rounds: rank of every adjacent pair, segmented minimum per
unit, merge of that pair at its leftmost non-overlapping places in all units at once,
compaction; units without a known pair leave the work array.

Sequential leftmost-best merging and one merge of all equal pairs differ only where the
merged piece can at once take part in a better-ranked merge.  Such pieces are found from the
vocabulary, and for them only the leftmost place of a unit is merged in a round, so the ids
are those of the sequential method.

A unit is a piece of text between places that no piece of the vocabulary reaches across: those between two characters
that are neighbours in no piece, found for a whole block of texts in one array operation over its bytes.
Each different unit is encoded once, and ids, decimal ids and decoded bytes of a text are taken from its units'.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tillsight.llm._units import PAD, Memory, blocks, by_unit, flat, in_slices, joined, release

SPACE = "▁"
_NONE = np.int64(1 << 40)
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


class Bpe:
    """Pieces of a BPE model as lookup arrays."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
        byte = [model.is_byte(i) for i in range(n)]
        self.byte_id = {int(_BYTE.fullmatch(p)[1], 16): i for i, p in enumerate(self.pieces) if byte[i]}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.special = {i for i in range(n) if special[i]}
        plain = {p: i for i, p in enumerate(self.pieces) if not special[i] and not byte[i]}
        self.char_id = {p: i for p, i in plain.items() if len(p) == 1}
        # rank: place in descending score; every split of a piece into two pieces is a known pair
        scores = {p: model.get_score(i) for p, i in plain.items()}
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        rank = np.full(n, _NONE, dtype=np.int64)
        for p, i in plain.items():
            rank[i] = order[scores[p]]
        left, right, merged = [], [], []
        for p, i in plain.items():
            for k in range(1, len(p)):
                a, b = plain.get(p[:k]), plain.get(p[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(i)
        left, right, merged = (np.array(x, dtype=np.int64) for x in (left, right, merged))
        key = left << 32 | right
        by = np.argsort(key)
        self.pair_key, self.pair_piece = key[by], merged[by]
        self.rank = rank
        self.pair_rank = rank[self.pair_piece]
        # a piece that, once made, can take part in a better-ranked merge than its own
        eager = np.zeros(n, dtype=bool)
        for part in (left, right):
            eager[part[rank[merged] <= rank[part]]] = True
        self.eager = eager
        # id of every code point (space as U+2581; -1: none, so its bytes are symbols) and of every byte
        self.code_point = np.full(0x110000, -1, dtype=np.int32)
        for c, i in self.char_id.items():
            self.code_point[ord(c)] = i
        self.code_point[ord(" ")] = self.code_point[ord(SPACE)]
        self.of_byte = np.array([self.byte_id[b] for b in range(256)], dtype=np.int32)
        # (last byte, first byte) of neighbouring characters of any piece; a text can be cut between all others
        self.inside = np.zeros((256, 256), dtype=bool)
        for p in plain:
            for x, y in zip(p, p[1:]):
                for last in {x.encode()[-1], (" " if x == SPACE else x).encode()[-1]}:
                    for first in {y.encode()[0], (" " if y == SPACE else y).encode()[0]}:
                        self.inside[last, first] = True
        shown = [b"" if special[i] else bytes([self.byte_of[i]]) if byte[i] else p.replace(SPACE, " ").encode()
                 for i, p in enumerate(self.pieces)]
        self.piece_bytes = pa.array(shown, pa.large_binary())
        self.decimal = pa.array([b"%d," % i for i in range(n)], pa.large_binary())

    def cuts(self, buf: np.ndarray) -> np.ndarray:
        """Places of a buffer at which a character starts and no piece reaches across."""
        here = buf[PAD:-PAD]
        return np.flatnonzero((here & 0xC0 != 0x80) & ~self.inside[buf[PAD - 1:-PAD - 1], here]) + PAD

    def _symbols(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Character ids (byte ids of characters that are no piece) of all units, and the unit of each."""
        whole = b"".join(units)
        buf = np.frombuffer(whole, np.uint8)
        unit = np.repeat(np.arange(len(units)), [len(u) for u in units])
        start = buf & 0xC0 != 0x80
        char = self.code_point[np.frombuffer(whole.decode().encode("utf-32-le"), np.uint32)][np.cumsum(start) - 1]
        use = start | (char < 0)
        return np.where(char < 0, self.of_byte[buf], char)[use].astype(np.int64), unit[use]

    def _pair_at(self, sym: np.ndarray, unit: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Number of the known pair that starts at each place, -1 for none."""
        out = np.full(at.size, -1, np.int64)
        inner = np.flatnonzero(at < sym.size - 1)
        inner = inner[unit[at[inner]] == unit[at[inner] + 1]]
        key = sym[at[inner]] << 32 | sym[at[inner] + 1]
        pair = np.minimum(np.searchsorted(self.pair_key, key), self.pair_key.size - 1)
        out[inner] = np.where(self.pair_key[pair] == key, pair, -1)
        return out

    def encode_units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in a row, and the number of ids of each."""
        sym, unit = self._symbols(units)
        pair = self._pair_at(sym, unit, np.arange(sym.size))
        done: list[tuple[np.ndarray, np.ndarray]] = [(sym[:0], unit[:0])]
        while sym.size:
            rank = np.where(pair >= 0, self.pair_rank[pair], _NONE)
            starts = np.flatnonzero(np.diff(unit, prepend=-1))
            sizes = np.diff(np.append(starts, sym.size))
            best = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            over = best == _NONE
            done.append((sym[over], unit[over]))
            keep = ~over
            hit = np.flatnonzero((rank == best) & keep)
            piece = self.pair_piece[pair[hit]]
            if hit.size:
                # leftmost non-overlapping: of a run of adjacent hits, every other one
                new = np.diff(hit, prepend=-2) != 1
                first = np.maximum.accumulate(np.where(new, np.arange(hit.size), 0))
                take = (np.arange(hit.size) - first) % 2 == 0
                lead = np.diff(unit[hit], prepend=-1) != 0
                wait = self.eager[piece[lead]][np.cumsum(lead) - 1]
                take &= ~wait | lead
                hit, piece = hit[take], piece[take]
            sym[hit] = piece
            keep[hit + 1] = False
            # only pairs beside a merged symbol have changed
            place = np.cumsum(keep) - 1
            sym, unit, pair = sym[keep], unit[keep], pair[keep]
            beside = np.zeros(sym.size + 1, bool)
            beside[place[hit]] = True
            beside[place[hit] - 1] = True
            near = np.flatnonzero(beside[:-1])
            pair[near] = self._pair_at(sym, unit, near)
        sym, unit = (np.concatenate(x) for x in zip(*done))
        return sym[np.argsort(unit, kind="stable")].astype(np.int32), np.bincount(unit, minlength=len(units))

    def decode(self, ids) -> str:
        """Text of ids: pieces joined, byte runs read as UTF-8, U+2581 as space, first space dropped."""
        return self.decode_parts(ids)[1:] if len(ids) and self._leads(ids[0]) else self.decode_parts(ids)

    def _leads(self, first: int) -> bool:
        return first not in self.special and first not in self.byte_of and self.pieces[first].startswith(SPACE)

    def decode_parts(self, ids) -> str:
        out, run = [], bytearray()
        for i in ids:
            i = int(i)
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            if i not in self.special:
                out.append(self.pieces[i])
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out).replace(SPACE, " ")


_models: dict[str, Bpe] = {}


def load(model_file: str) -> Bpe:
    """The model of a file, read once in a Python worker."""
    if model_file not in _models:
        _models[model_file] = Bpe(model_file)
    return _models[model_file]


class Encoder:
    """Encodes and decodes blocks of texts, each different unit of theirs once."""

    def __init__(self, model_file: str):
        self.bpe = load(model_file)
        self.memory = Memory(self._build, self.bpe.cuts)

    def _build(self, units: list[bytes]) -> pa.Table:
        """Ids of each unit, their decimal text with a comma behind every id, and the decoded bytes."""
        ids, counts = self.bpe.encode_units(units)
        bounds = np.concatenate(([0], np.cumsum(counts)))
        at = pa.array(ids)
        return pa.table({
            "n": pa.array(counts, pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), at),
            "shown": by_unit(self.bpe.decimal.take(at), bounds),
            "decoded": by_unit(self.bpe.piece_bytes.take(at), bounds)})

    def columns(self, texts: pa.Array, digest: bool) -> list[pa.Array]:
        """Per text the number of ids, the ids or their digest, and the decoded text or its digest."""
        parts = []
        for block in blocks(texts):
            rows, bounds = self.memory.of(block)
            n = np.diff(np.concatenate(([0], np.cumsum(rows["n"].to_numpy())))[bounds])
            decoded, edge = joined(rows["decoded"])
            # the space that led the text isn't part of it
            texts_of = [decoded[s + 1:e] for s, e in zip(edge[bounds[:-1]], edge[bounds[1:]])]
            if digest:
                shown, edge = joined(rows["shown"])
                ids_of = [shown[s:max(s, e - 1)] for s, e in zip(edge[bounds[:-1]], edge[bounds[1:]])]
                parts.append([pa.array(n)] + [pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string())
                                              for xs in (ids_of, texts_of)])
            else:
                ids, edge = flat(rows["ids"])
                lists = pa.ListArray.from_arrays(pa.array(edge[bounds].astype(np.int32)), pa.array(ids, pa.int32()))
                parts.append([pa.array(n), lists, pa.array(map(bytes, texts_of), pa.binary()).cast(pa.string())])
        types = [pa.int64()] + ([pa.string()] * 2 if digest else [pa.list_(pa.int32()), pa.string()])
        return [pa.concat_arrays([p[k] for p in parts]) if parts else pa.array([], t) for k, t in enumerate(types)]


def encode(docs: DataFrame, model_file: str, text: str = "text", digest: bool = False, keep_text: bool = True) -> DataFrame:
    """Add the ids of every whole text (null: no ids) and their decoded text.

    Adds ``n_tokens``, ``ids`` (array<int>) and ``decoded``; with ``digest`` the last two are
    replaced by ``ids_sha256`` (decimal ids joined by commas) and ``decoded_sha256`` (UTF-8).
    Columns of ``docs`` with these names are replaced; the others stay, the text only if it is to be kept.  No shuffle: every
    slice of an Arrow batch is encoded in place, with no state between batches but a bounded memory of units.
    """
    added = [("n_tokens", "bigint")] + ([("ids_sha256", "string"), ("decoded_sha256", "string")] if digest
                                         else [("ids", "array<int>"), ("decoded", "string")])
    names = {n for n, _ in added}
    kept = docs.select(*[f"`{c}`" for c in docs.columns if c not in names])
    handed_on = [f for f in kept.schema.fields if keep_text or f.name != text]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in handed_on]
                       + [f"{n} {t}" for n, t in added])

    def run(batches):
        enc = Encoder(model_file)
        for batch in in_slices(batches, at_text):
            cols = enc.columns(batch.column(at_text), digest)
            held = [batch.column(batch.schema.get_field_index(f)) for f in left]
            yield pa.RecordBatch.from_arrays([*held, *cols], names=[*left, *names_in_order])
            del cols, held
            release()
        del enc
        release()

    names_in_order, left = [n for n, _ in added], [f.name for f in handed_on]
    at_text = [f.name for f in kept.schema.fields].index(text)
    return kept.mapInArrow(run, schema)
