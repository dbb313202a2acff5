"""Encoder against the library, page text, shards."""

from __future__ import annotations

import hashlib
import random
import zlib

import pyarrow as pa
import pytest

from tillsight.llm import kd_shards, main_text, sp_bpe
from tillsight.llm.queries import tokenizer_path

TEXTS = [None, "", " ", "  a  b ", "Hello world\n\n\tx", "▁a ▁b", "<s> </s> <0x0A>", "\U0001F600 中文字 é ﬁ\x00", "a" * 4000,
         " " * 70 + "x", "aaab" * 300 + " baaa", "1234567890 12,345.67", "Hello world\n\n\tx"]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())


def test_words_are_encoded_as_by_the_library(library):
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choice("abeintorsh ▁.,012\n") for _ in range(rng.randint(1, 200))) for _ in range(400)]
    texts += ["".join(rng.choice("abinteros") for _ in range(800)) for _ in range(5)]
    columns = sp_bpe.Encoder(tokenizer_path()).columns(pa.array(texts, pa.string()), False)
    got = list(zip(*[c.to_pylist() for c in columns]))
    want = library.encode([t or "" for t in texts], num_threads=1)
    assert [g[1] for g in got] == want
    assert [g[2] for g in got] == [library.decode(w) for w in want]


def test_decode_of_ids(library):
    bpe = sp_bpe.load(tokenizer_path())
    for t in TEXTS:
        ids = library.encode(t or "")
        assert bpe.decode(ids) == library.decode(ids)


def test_encode_frame_digests_nulls_and_clashing_columns(spark, library):
    rows = [(i, t, "old", i) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids_sha256 string, n_tokens int")
    got = {r["doc_id"]: r for r in sp_bpe.encode(df, tokenizer_path(), digest=True).collect()}
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert sp_bpe.encode(df.limit(0), tokenizer_path()).count() == 0


PAGES = {
    "": "", "<p>": "", "a<b": "a", "<html><body>plain text": "plain text", "<script>x": "", "<!-- x": "",
    '<p title="a>b">q</p>': "q", "<p>a<div>b</div>c</p>": "a b c",
    "<div class=content><h2>T</h2><p>Hello, &nbsp;x&eacute; &amp;amp;<p>Two</p><div class='comments'><p>c</p></div></div>"
    "<div class=sidebar>no</div>": "T Hello, xé &amp; Two",
    "<nav><a href=/>x</a></nav><article><h1>T</h1><p><b>B<br><p>one\n  two</p><form>f</form><aside>s</aside></article>"
    "<footer>foot</footer>": "T B one two",
    "<article><section><p>a, b, c</p></section><section><p>d</p></section></article><div class='ad'>buy</div>": "a, b, c d",
    "<table><tr><td>a<td>b<tr><td>c</table>": "a b c", "<div>" * 3000 + "deep" + "</div>" * 3000: "deep",
}


def test_page_text():
    for html, want in PAGES.items():
        assert main_text.extract_one(html) == want, html[:80]


def test_extract_frame(spark):
    rows = [(1, "u", None, 9), (2, None, "<article><p>x y</p></article>", 9), (2, None, "<article><p>x y</p></article>", 9),
            (None, "u", "<p>" + "word, " * 50_000 + "</p>", 9)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, n_chars int")
    got = main_text.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    out = sorted((r["page_id"] or 0, r["text"][:10], r["n_chars"]) for r in got.collect())
    assert out == [(0, "word, word", 299_999), (1, "", 0), (2, "x y", 3), (2, "x y", 3)]
    assert main_text.extract(df.limit(0)).count() == 0


def test_shards_are_even_and_slots_gapless(spark):
    from pyspark.sql import functions as F

    rng = random.Random(1)
    # one source holds a third of the rows, one text is repeated often
    rows = [(i, "same" if i % 5 == 0 else "x" * rng.randint(0, 900), "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(4000)]
    rows += [(5000, None, None), (5001, "", "s1")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 16
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    dims = [F.log2(size), F.crc32(F.encode("source", "UTF-8")), F.col("doc_id")]
    got = kd_shards.shard(df, "doc_id", size, dims, n_shards=7, keep={"crc": crc}).toPandas()
    assert sorted(got.doc_id) == sorted(r[0] for r in rows)
    text = {r[0]: (r[1] or "").encode() for r in rows}
    assert all(w == len(text[i]) + 16 and c == zlib.crc32(text[i]) for i, w, c in zip(got.doc_id, got.weight, got.crc))
    total = got.groupby("shard").weight.sum()
    assert len(total) == 7 and total.max() <= 1.02 * total.mean() and total.min() >= 0.98 * total.mean()
    for _, slots in got.groupby("shard").slot:
        assert sorted(slots) == list(range(len(slots)))


def test_shards_of_odd_tables(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, 5), (1, 5), (None, 5)], "doc_id bigint, n int")
    got = kd_shards.shard(df, "doc_id", F.col("n"), [F.col("n")], n_shards=2).toPandas()
    assert len(got) == 3 and all(sorted(s) == list(range(len(s))) for _, s in got.groupby("shard").slot)
    assert kd_shards.shard(df.limit(0), "doc_id", F.col("n"), [F.col("n")], n_shards=3).count() == 0
    one = kd_shards.shard(df, "doc_id", F.col("n"), [F.col("n")], target_bytes=100)
    assert {r["shard"] for r in one.collect()} == {0}


def test_page_text_behind_stray_quotes():
    for tag in ('<p class="a"">', "<p title=it's>", '<p title=5">', "<p 'x>", '<p a = "b>c" d=\'e"\'>', '<p x="never ends>'):
        assert main_text.extract_one(f"<article>{tag}one</p><p>two</p></article>") == "one two", tag
    assert main_text.extract_one('<article><p class="a"">one</p><p class="b">two</p></article>') == "one two"
    assert main_text.extract_one('<p title="a>b') == 'b'
    assert len(main_text.extract_one('<p a="">x</p>' * 20_000 + '<p a="y>z')) == 40_000 + 1


def test_paragraphs_and_headings_beside_the_container():
    body = "".join(f"<p>Body {k}, with words, and more words to read, line after line.</p>" for k in range(8))
    lead = "A lead paragraph of one sentence."
    long = "word " * 20 + "<a href='/'>link</a>"
    page = (f"<div><h1>Title</h1><p>{lead}</p><p>{long}</p>loose text.<div class=body>{body}</div><p>Share</p>"
            f"<p><a href='/'>A link, nothing else, of more than eighty characters, which is not prose at all, is it?</a></p>"
            f"<h3>More</h3><ul><li><a href='/'>one</a></ul></div>")
    got = main_text.extract_one(page)
    assert got == " ".join(["Title", lead, "word " * 20 + "link", "loose text."]
                           + [f"Body {k}, with words, and more words to read, line after line." for k in range(8)])


PROSE = "".join(f"<p>Ordinary words of paragraph {k}, with a comma, and more text that reads on for a while.</p>" for k in range(6))


@pytest.mark.parametrize("page", [
    '<div style="overflow: hidden">{}</div>', '<div class="overflow-hidden">{}</div>', '<div class="content no-sidebar">{}</div>',
    '<div class="post comments-open">{}</div>', '<article class="post comment-closed">{}</article>',
    '<div class="article-header-fixed">{}</div>', '<main><section class="related-work">{}</section></main>',
    '<article><div data-id="search">{}</div></article>', '<form id="aspnetForm"><div>{}</div></form>',
    '<div data-class="comments" title="id=footer hidden">{}</div>', '<article class="promo">{}</article>'])
def test_marks_of_the_page_are_not_marks_of_the_article(page):
    assert main_text.extract_one(page.format(PROSE)) == main_text.extract_one(f"<article>{PROSE}</article>") != ""


@pytest.mark.parametrize("part", [
    '<div class="comments">{}</div>', '<section id=disqus_thread>{}</section>', '<div class="cookie-notice">{}</div>',
    '<div hidden>{}</div>', '<form>{}</form>', '<div role="complementary">{}</div>', '<aside>{}</aside>',
    '<div aria-hidden="true">{}</div>', '<ul class="menu">{}</ul>', '<span class="share">{}</span>'])
def test_marked_parts_of_an_article_are_left_out(part):
    want = main_text.extract_one(f"<article>{PROSE}</article>")
    assert main_text.extract_one(f"<article>{PROSE}{part.format('Short text, of a part.')}</article>") == want
    if "comments" in part or "disqus" in part:
        assert main_text.extract_one(f"<article>{PROSE}{part.format(3 * PROSE)}</article>") == want


def _grown(rng, depth=0):
    """A random tree: (tag, children), children being trees or (text, linked) pairs."""
    children = []
    for _ in range(rng.randint(1, 4)):
        if depth < 4 and rng.random() < 0.6:
            children.append(_grown(rng, depth + 1))
        else:
            text = " ".join(rng.choice(["word", "text,", "of", "more,", "pages"]) for _ in range(rng.randint(1, 40)))
            children.append(("p", [(text, rng.random() < 0.3)]))
    return (rng.choice(["div", "div", "div", "section", "ul"]) if depth else "div", children)


def _html(node):
    tag, children = node
    inner = "".join((f"<a href=x>{c[0]}</a>" if c[1] else c[0]) if isinstance(c[1], bool) else _html(c) for c in children)
    return f"<{tag}>{inner}</{tag}>"


def _best_by_brute_force(root):
    """Texts of the container with the most points, each node's points summed from all paragraphs below it."""
    nodes, above = [], {}

    def walk(node, path):
        nodes.append((node, path))
        for c in node[1]:
            if not isinstance(c[1], bool):
                walk(c, [*path, id(node)])

    walk(root, [])
    points, order = {}, {}
    for k, (node, path) in enumerate(nodes):
        order[id(node)] = k
        above[id(node)] = path
        if node[0] == "p":
            text = node[1][0][0]
            gives = 1 + text.count(",") + min(len(text) / 100, 3)
            for level, up in enumerate(path[::-1][:5]):
                points[up] = points.get(up, 0) + gives / (1, 2, 6, 9, 12)[level]

    def chars(node, linked):
        return sum((len(c[0]) if c[1] or not linked else 0) if isinstance(c[1], bool) else chars(c, linked) for c in node[1])

    score = {id(n): points[id(n)] * (1 - chars(n, True) / chars(n, False)) for n, _ in nodes if id(n) in points}
    best = max(score, key=lambda i: (round(score[i], 9), -order[i]))
    return best, score, above, nodes, order


def test_generated_pages_keep_the_container_of_most_points():
    rng = random.Random(8)
    for _ in range(200):
        root = ("#", [("body", [_grown(rng)])])
        best, score, above, nodes, order = _best_by_brute_force(root)
        around = above[best][-1] if above[best] else None
        kept = {best} | {i for i in score if above[i] and above[i][-1] == around and score[i] >= max(10, 0.2 * score[best])}
        inside = [n[1][0][0] for n, path in nodes if n[0] == "p" and kept & set(path)]
        got = main_text.extract_one("".join(_html(c) for c in root[1]))
        at = 0
        for text in inside:  # prose beside the container may stand between them
            at = got.index(text, at) + len(text)
        beside = [n[1][0][0] for n, path in nodes if n[0] == "p" and not kept & set(path) and path[-1] != around]
        assert len(got) <= sum(len(t) + 1 for t in inside) + sum(
            len(n[1][0][0]) + 1 for n, path in nodes if n[0] == "p" and not kept & set(path)) - sum(
            len(t) + 1 for t in beside)


@pytest.mark.parametrize("parts", [1, 6])
def test_copies_of_one_row_are_spread_over_the_shards(spark, parts):
    from pyspark.sql import functions as F

    rows = [(7, "the same text")] * 3000 + [(100 + i, "x" * (i % 50)) for i in range(1000)] + [(None, None)] * 200
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 16
    got = kd_shards.shard(df, "doc_id", size, [F.log2(size), F.col("doc_id")], n_shards=40,
                          keep={"crc": F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))}).toPandas()
    assert len(got) == len(rows)
    total = got.groupby("shard").weight.sum()
    assert len(total) == 40 and total.max() <= 1.05 * total.mean() and total.min() >= 0.95 * total.mean()
    for _, slots in got.groupby("shard").slot:
        assert sorted(slots) == list(range(len(slots)))


def test_shards_equal_weighted_medians_taken_one_node_at_a_time(spark):
    """Each split leaves a part of the bytes next to the wanted one, along the widest dimension of the node."""
    from pyspark.sql import functions as F

    rng = random.Random(3)
    rows = [(i, rng.randint(16, 400), rng.random() ** 3, rng.choice([0.0, 0.2, 0.21, 1.0])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, n bigint, x double, y double")
    got = {r["doc_id"]: r["shard"] for r in kd_shards.shard(df, "doc_id", F.col("n"), [F.col("x"), F.col("y")], n_shards=12)
           .collect()}
    spread = [max(r[d] for r in rows) - min(r[d] for r in rows) for d in (2, 3)]

    def check(members, first, shares):
        if shares == 1:
            assert {got[r[0]] for r in members} == {first}
            return
        left = [r for r in members if got[r[0]] < first + shares // 2]
        right = [r for r in members if got[r[0]] >= first + shares // 2]
        wide = [(max(r[d] for r in members) - min(r[d] for r in members)) / spread[d - 2] for d in (2, 3)]
        d = 2 if wide[0] >= wide[1] - 0.002 else 3
        ordered = [dim for dim in (d, 5 - d) if max(r[dim] for r in left) <= min(r[dim] for r in right)]
        assert ordered and (ordered[0] == d or abs(wide[0] - wide[1]) < 0.002)
        goal = sum(r[1] for r in members) * (shares // 2) / shares
        assert abs(sum(r[1] for r in left) - goal) <= 400
        check(left, first, shares // 2)
        check(right, first + shares // 2, shares - shares // 2)

    check(rows, 0, 12)
