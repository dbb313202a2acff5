"""URL rules against plain parsing, templates against a tree grown host by host."""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tillsight.llm import url_templates as ut
from tillsight.llm.queries import URL_RULES


def _parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    return host, re.split("[?#]", rest[cut:])[0]


def _rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES
            if ("." + host).endswith("." + h) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def _shape(path):
    out = []
    for k, s in enumerate(path.split("/")):
        if k > ut.DEPTH:
            out.append("**")
            break
        body, end = re.fullmatch(r"(.*?)((?:\.[A-Za-z0-9]{1,5})?)", s, re.S).groups()
        for form, name in (("[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", "{u}"),
                           ("[0-9]{4}-[0-9]{2}(-[0-9]{2})?", "{d}"), ("[0-9]+", "{n}"),
                           ("(?=.*[0-9])[0-9a-fA-F]{8,}", "{h}")):
            if k and re.fullmatch(form, body):
                s = name + end
        out.append(s)
    return out


def _verdicts(rows):
    """(host, path, bad) -> rejected, by recursion over one host's tree at a time."""
    tree = defaultdict(list)
    for k, (host, path, bad) in enumerate(rows):
        tree[host].append((k, _shape(path), bad))
    rejected = set()

    def grow(members, depth):
        here = [m for m in members if len(m[1]) == depth]
        labels = [b for _, _, b in here if b is not None]
        if here and (sum(labels) + ut.SMOOTH * ut.PRIOR) / (len(labels) + ut.SMOOTH) >= ut.REJECT:
            rejected.update(k for k, _, _ in here)
        below = [m for m in members if len(m[1]) > depth]
        child = defaultdict(list)
        for m in below:
            child[m[1][depth]].append(m)
        all_labels = [b for _, _, b in below if b is not None]
        branches = defaultdict(list)
        for segment, ms in child.items():
            own = [b for _, _, b in ms if b is not None]
            rest = len(all_labels) - len(own)
            keep = len(ms) >= ut.MIN_ROWS
            if keep and len(own) >= ut.MIN_LABELS and rest >= ut.MIN_LABELS:
                p = sum(all_labels) / len(all_labels)
                gap = abs(sum(own) / len(own) - (sum(all_labels) - sum(own)) / rest)
                keep = gap > ut.Z * math.sqrt(p * (1 - p) * (1 / len(own) + 1 / rest))
            branches[segment if keep else "*"] += ms
        for ms in branches.values():
            grow(ms, depth + 1)

    for members in tree.values():
        grow(members, 1)
    return rejected


def _urls(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        host = rng.choice(["A.example.com", "b.Example.org", "b.example.org", "deep.a.example.net", "x.net", "org"])
        parts = [rng.choice(["de", "en", "fr", "tag", "tag", f"p{rng.randrange(400)}"])]
        parts += [rng.choice([str(rng.randrange(999)), "2024-01-02", "deadbeef01.html", "about", f"w{rng.randrange(50)}",
                              "123e4567-e89b-12d3-a456-426614174000"]) for _ in range(rng.randrange(3))]
        parts += ["x"] * (20 if rng.random() < 0.02 else 0)
        out.append("https://" + host + "/" + "/".join(parts) + rng.choice(["", "/", "?a=/b", "#c/d", ".html", "/?x"]))
    return out


ODD = [None, "", "no scheme/de/", "http://", "http://x.net", "http://X.NET/", "http://x.net?q=/", "a://b://c/de/", "//x.net/",
       "http://notexample.com/de/1", "http://example.com/de/1", "http://a.example.com/de", "http://org/fr/", "http://aorg/fr/",
       "http://example.net/en/1#x", "http://\u00c9.org/fr/\u00e9\n2", "http://x.org/fr/" + "a/" * 5000, "http://x.org//fr/"]


def test_hosts_paths_and_rules(spark):
    urls = ODD + _urls(1, 300) + ODD[:3]
    df = spark.createDataFrame([(k, u, "old", 1) for k, u in enumerate(urls)],
                               "page_id int, url string, host string, template int")
    got = {r["page_id"]: r for r in ut.judge(df, URL_RULES).collect()}
    assert len(got) == len(urls)
    for k, u in enumerate(urls):
        host, path = _parse(u)
        rule, verdict = _rule(host, path)
        assert (got[k]["host"], got[k]["path"], got[k]["rule"], got[k]["template"]) == (host, path, rule, 1)
        assert got[k]["verdict"] == verdict or rule is None and got[k]["verdict"] in ("allow", "block")
    assert got[0]["verdict"] == "allow"
    assert ut.judge(df.limit(0), URL_RULES).count() == 0


@pytest.mark.parametrize("seed", [2, 3])
def test_templates_equal_a_tree_of_each_host(spark, seed):
    rng = random.Random(seed)
    rate = defaultdict(lambda: rng.choice([0.02, 0.5, 0.98]))
    rows = []
    for u in _urls(seed, 3000):
        host, path = _parse(u)
        key = (host, path.split("/")[1])
        bad = None if rng.random() < 0.4 else rng.random() < (rate[key] if key[1] in ("de", "en", "fr") else 0.9)
        rows.append((u, bad))
    df = spark.createDataFrame([(k, u, b) for k, (u, b) in enumerate(rows)], "page_id int, url string, bad boolean")
    got = ut.judge(df.repartition(5), [], bad=F.col("bad"))
    blocked = {r["page_id"] for r in got.where("verdict = 'block'").collect()}
    want = _verdicts([(*_parse(u), b) for u, b in rows])
    assert blocked == want and 0 < len(want) < len(rows)


def test_unlabelled_templates_pass_and_variable_segments_share_labels(spark):
    urls = [(f"http://spam.example/buy/{k}.html", True) for k in range(30)]
    urls += [("http://spam.example/buy/99999.html", None), ("http://spam.example/help/1.html", None),
             ("http://other.example/buy/1.html", None)]
    df = spark.createDataFrame([(k, u, b) for k, (u, b) in enumerate(urls)], "page_id int, url string, bad boolean")
    got = {r["page_id"]: r["verdict"] for r in ut.judge(df, [], bad=F.col("bad")).collect()}
    assert [got[k] for k in (0, 30, 31, 32)] == ["block", "block", "allow", "allow"]


def test_a_blocked_branch_does_not_block_its_neighbours(spark):
    urls = [f"http://small.example.com/{x}/{k}" for x, n in (("de", 9), ("en", 12), ("fr", 6)) for k in range(n)]
    urls += [f"http://most.example.com/{x}/{k}" for x, n in (("de", 19), ("xx", 1)) for k in range(n)]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r["url"]: (r["rule"], r["verdict"]) for r in ut.judge(df, URL_RULES).collect()}
    assert all(v == (("example.com/de/", "block") if "/de/" in u else (None, "allow"))
               for u, v in got.items() if "small" in u)
    # rare segments are one template, of which nearly all is blocked
    assert got["http://most.example.com/xx/0"] == (None, "block")
