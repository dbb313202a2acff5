"""Alignment of two tokenizers against occurrence-by-occurrence code and dense matrices."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tillsight.llm import token_align as ta
from tillsight.llm._units import cut
from tillsight.llm.queries import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path()
TEXTS = [None, "", " ", "  a  b ", "Hello world\n\n\tx", "▁a ▁b", "<|endoftext|> <s> <unk> <0x0A>", "\U0001F600 中文字 é ﬁ\x00",
         "a" * 3000, " " * 70 + "x", "1234567890 12,345.67", "Hello world\n\n\tx", "unbelievable internationalisation"]


def _libraries(texts):
    """Ids of whole texts by the libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    return [(a.encode(" " + t, add_special_tokens=False).ids if t else [], b.encode(t) if t else []) for t in texts]


def _plain(texts):
    """Ids, groups and links token by token."""
    of_a, of_b = ta.side(ta.ByteLevel, A).bytes_of, ta.side(ta.Pieces, B).bytes_of
    out = []
    for t, (ids_a, ids_b) in zip(texts, _libraries(texts)):
        raw = b" " + t.encode() if t else b""
        if b"".join(of_a[i] for i in ids_a) != raw or b"".join(of_b[i] for i in ids_b) != raw:
            ids_a, ids_b = [], []
        ends_a = np.cumsum([len(of_a[i]) for i in ids_a]).tolist()
        ends_b = np.cumsum([len(of_b[i]) for i in ids_b]).tolist()
        common = sorted(set(ends_a) & set(ends_b))
        group = lambda ends: [sum(c < e for c in common) for e in ends]
        out.append((ids_a, ids_b, ends_a, ends_b, group(ends_a), group(ends_b)))
    return out


def _overlaps(ids_a, ids_b, ends_a, ends_b):
    of_a, of_b = ta.side(ta.ByteLevel, A).bytes_of, ta.side(ta.Pieces, B).bytes_of
    for i, (x, e) in enumerate(zip(ids_a, ends_a)):
        for j, (y, f) in enumerate(zip(ids_b, ends_b)):
            shared = min(e, f) - max(e - len(of_a[x]), f - len(of_b[y]))
            if shared > 0:
                yield i, j, shared, e == f


def test_products_equal_dense_ones():
    rng = np.random.default_rng(2)
    for block in (1, 3, 1000):
        x, y = rng.integers(0, 3, (7, 9)), rng.integers(0, 3, (9, 5))
        as_csr = lambda m: ta.Csr(
            np.concatenate(([0], np.cumsum((m > 0).sum(1)))), np.nonzero(m)[1], m.shape[1], m[np.nonzero(m)])
        got = as_csr(x).times(as_csr(y), block)
        dense = np.zeros((7, 5), int)
        dense[got.rows(), got.indices] = got.data
        assert (dense == x @ y).all()
        turned = as_csr(x).transposed()
        dense = np.zeros((9, 7), int)
        dense[turned.rows(), turned.indices] = turned.data
        assert (dense == x.T).all()


def test_units_are_cut_where_no_token_reaches_across():
    rng = random.Random(3)
    words = ["alpha", "beta", "x1", "don't", "\n", "  ", "...", "é", "12", "(a", "b)", "\u00a0", "\u3000x", "x\u2009", "▁", "—",
             "中文", "\x1c", "\x85", "s'", "'s", "ﬁ", "\u180e", "\u200b", "_"]
    texts = [rng.choice(["", " "]).join(rng.choice(words) + rng.choice(["", " "]) for _ in range(80)) for _ in range(400)]
    texts += [" ".join(rng.choice(words) for _ in range(80)) for _ in range(400)]
    units, bounds = cut([t.encode() for t in texts], ta.cuts(ta.side(ta.ByteLevel, A), ta.side(ta.Pieces, B)))
    parts = units.to_pylist()
    assert len(parts) > 50 * len(texts)
    for k, (kind, file) in enumerate(((ta.ByteLevel, A), (ta.Pieces, B))):
        ids, counts = ta.side(kind, file).encode(parts)
        ids = np.split(ids, np.cumsum(counts)[:-1])
        for t, lo, hi, want in zip(texts, bounds[:-1], bounds[1:], _libraries(texts)):
            assert b"".join(parts[lo:hi]).decode() == " " + t
            assert [i for x in ids[lo:hi] for i in x] == want[k], t


@pytest.mark.parametrize("links", ta.LINKS)
def test_tokens_groups_and_links(spark, links):
    texts = TEXTS[:8] + TEXTS[9:]
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id int, text string, a_ids string")
    got = {r["doc_id"]: r for r in ta.align(df, A, B, links=links).collect()}
    for i, (ids_a, ids_b, ends_a, ends_b, group_a, group_b) in enumerate(_plain(texts)):
        r = got[i]
        assert (r["a_ids"], r["b_ids"], r["a_groups"], r["b_groups"]) == (ids_a, ids_b, group_a, group_b)
        if links == "group":
            want = [(x, y, 1) for x, g in enumerate(group_a) for y, h in enumerate(group_b) if g == h]
        else:
            want = [(x, y, n) for x, y, n, ends in _overlaps(ids_a, ids_b, ends_a, ends_b) if ends or links == "overlap"]
        assert list(zip(r["link_a"], r["link_b"], r["link_bytes"])) == want


def test_statistics_of_links(spark):
    rng = random.Random(5)
    syllables = ["ing", "tion", "pre", "al", "ti", "un", "ness", "ca", "do", "é"]
    texts = TEXTS + [" ".join("".join(rng.choices(syllables, k=rng.randint(1, 5))) for _ in range(rng.randint(1, 60)))
                     for _ in range(60)] * 2
    rows = [(None if i == 14 else i % 100, t, i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id int, text string, n_links int").repartition(5)
    plain = _plain(texts)
    pairs = [[(a[x], b[y]) for x, y, _, ends in _overlaps(a, b, ea, eb) if ends] for a, b, ea, eb, _, _ in plain]
    count = Counter(p for ps in pairs for p in ps)
    highest = {}
    for (_, y), n in count.items():
        highest[y] = max(n, highest.get(y, 0))
    want = []
    for (doc, _, _), (a, b, _, _, ga, gb), ps in zip(rows, plain, pairs):
        n = max(ga, default=-1) + 1
        shown = ";".join(",".join(str(x) for x, g in zip(a, ga) if g == k) + "|"
                         + ",".join(str(y) for y, g in zip(b, gb) if g == k) for k in range(n))
        want.append((doc, len(a), len(b), n, len(ps), sum(count[p] == highest[p[1]] for p in ps),
                     sum(count[p] for p in ps), hashlib.sha256(shown.encode()).hexdigest() if a else ""))
    got = [tuple(r) for r in ta.link_statistics(df, A, B).collect()]
    key = lambda r: (r[0] is None, r)[0:1] + tuple(map(str, r))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert ta.link_statistics(df.limit(0), A, B).count() == 0
