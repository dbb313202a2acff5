"""Personal data in texts with DataFrame functions only: checked formats, and boosted trees over wider candidates.

Base kinds have a fixed format and a check (``BASE``); their spans always count.  High-recall
generators (``WIDE``) propose more spans, which may overlap.  Boosted trees score a
candidate by its format and the signs around it; each generator's threshold is the lowest score
at which its candidates in texts that the trees haven't seen reach ``PRECISION``.

The trees learn from distant labels: a candidate is a positive where there is evidence that is not
among the features (a keyword in the text before it, a valid check digit).  Features are small
whole numbers, so the whole corpus is one table of cells (features, candidates, positives)
whose size is bounded by the features' ranges; only that reaches the driver, where the trees are
fitted, and they come back as an expression.

Positions are code points.  A text's matches are marked by one ``regexp_replace``, split at the
marks, and placed by sums over blocks of ``BLOCK`` pieces; no match looks at the whole text again.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, SHUT, OTHER = "\x01", "\x02", "\x03"
BLOCK = 256
PRECISION = 0.8
TREES = 24
RATE = 0.3
CONTEXT = 24
#: One text in so many calibrates; a generator with fewer positives there is calibrated on all texts.
FOLDS, LEAST = 4, 8

LOCAL = "A-Za-z0-9._%+-"


@dataclass(frozen=True)
class Kind:
    """A kind of span: its pattern, a cheap sign that a text may hold one, and the check of a match."""

    name: str
    pattern: str
    sign: str


# Patterns search like the plain ones they stand for, without repeated starts or recursion:
# a run can only match from its own start (or where the match before ended).
BASE = [
    Kind("email", f"(?:(?<![{LOCAL}])|\\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++", "@"),
    Kind("ip", "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++", "[0-9]\\.[0-9]"),
    Kind("card", "(?<![0-9])(?<![0-9][\\x20-])[0-9](?:[\\x20-]?[0-9]){15,18}(?![\\x20-]?[0-9])", "[0-9][\\x20-]?[0-9]"),
    Kind("phone", "\\+[0-9][\\x20().0-9-]+[0-9]", "\\+[0-9]"),
]
WIDE = [
    Kind("secret", "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+", "[A-Za-z0-9+/_=-]{20}"),
    Kind("number", "(?<![0-9(])[0-9(][0-9().\\x20-]{6,}[0-9]", "[0-9(][0-9().\\x20-]{6}[0-9]"),
    Kind("iban", "\\b[A-Z]{2}[0-9]{2}(?:\\x20?[A-Z0-9]{4}){2,7}(?:\\x20?[A-Z0-9]{1,3})?\\b", "[A-Z]{2}[0-9]{2}"),
]
EVIDENCE = {
    "secret": "token|secret|passw|api.?key|access.?key|private.?key|credential|bearer|auth",
    "number": "phone|tel[.: ]|mobile|fax|call|account|ssn|passport|tax.?id",
    "iban": "iban|account|konto|compte|cuenta",
}
FEATURES = ("kind", "length", "digits", "upper", "hex", "separators", "quoted", "assigned", "cut", "mixed")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit is right."""
    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _small_part(part: Column) -> Column:
    short = F.ltrim(part, F.lit("0"))
    return F.when(F.length(short) > 3, F.lit(False)).otherwise(F.coalesce(short.try_cast("int"), F.lit(0)) <= 255)


def valid(kind: str, match: Column) -> Column:
    """The check of a base kind."""
    if kind == "ip":
        return F.forall(F.split(match, "\\."), _small_part)
    if kind == "card":
        return _luhn(_digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    return F.lit(True)


def _is_valid(kind: Kind):
    return lambda c: valid(kind.name, c["m"])


def _pieces(text: Column, kind: Kind) -> Column:
    """The text before the first match, then each match, a mark, and the text up to the next; null without a sign.

    Every kind but email and secret needs a digit: most texts are done after one look for one.
    """
    if kind.name == "email":
        may = text.contains("@")
    else:
        may = text.rlike(kind.sign) if kind.name == "secret" else text.rlike("[0-9]") & text.rlike(kind.sign)
    return F.when(may, F.split(F.regexp_replace(text, kind.pattern, f"{OPEN}$0{SHUT}"), OPEN))


def _match(piece: Column) -> Column:
    return F.substring_index(piece, SHUT, 1)


def _rest(piece: Column) -> Column:
    return F.substring_index(piece, SHUT, -1)


def _total(part: Column) -> Column:
    return F.aggregate(part, F.lit(0), lambda acc, x: acc + x)


def _set(df: DataFrame, made: dict[str, Column], drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with columns made or replaced, in one projection."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in made and c not in drop],
                     *[v.alias(n) for n, v in made.items()])


def with_matches(df: DataFrame, kinds: list[Kind], text: str) -> DataFrame:
    """Add a column ``_<kind>`` for each kind: its matches in order, each with s, e (end exclusive), m, before, after."""
    one, names = F.lit(1), [k.name for k in kinds]
    df = _set(df, {f"_p_{k.name}": _pieces(F.col(text), k) for k in kinds})
    df = _set(df, {f"_l_{n}": F.transform(f"_p_{n}", lambda p, i: F.length(p) - F.when(i > 0, 1).otherwise(0))
                   for n in names})

    def block_sums(n: str) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(f"_l_{n}") - 1) / BLOCK).cast("int"))
        return F.when(F.size(f"_p_{n}") > 1, F.transform(
            blocks, lambda b: _total(F.slice(f"_l_{n}", b * BLOCK + 1, F.lit(BLOCK)))))

    def offsets(n: str) -> Column:
        return F.transform(f"_b_{n}", lambda x, b: _total(F.slice(f"_b_{n}", one, b)))

    def matches(n: str) -> Column:
        def place(i: Column) -> Column:
            b = F.floor(i / BLOCK).cast("int")
            start = F.get(f"_o_{n}", b) + _total(F.slice(f"_l_{n}", b * BLOCK + 1, i - b * BLOCK))
            m, before, after = _around(F.get(f"_p_{n}", i - 1), F.get(f"_p_{n}", i))
            return F.struct(start.alias("s"), (start + F.length(m)).alias("e"), m.alias("m"), before.alias("before"),
                            after.alias("after"))

        found = F.when(F.size(f"_p_{n}") > 1, F.transform(F.sequence(one, F.size(f"_p_{n}") - 1), place))
        none = F.array().cast("array<struct<s:int,e:int,m:string,before:string,after:string>>")
        return F.coalesce(found, none)

    df = _set(df, {f"_b_{n}": block_sums(n) for n in names})
    df = _set(df, {f"_o_{n}": offsets(n) for n in names})
    return _set(df, {f"_{n}": matches(n) for n in names}, tuple(f"_{x}_{n}" for n in names for x in "plbo"))


def _around(last: Column, piece: Column) -> tuple[Column, Column, Column]:
    """A piece's match, the text before it (the end of the piece before) and the text after it."""
    return _match(piece), F.right(_rest(last), F.lit(CONTEXT)), F.left(_rest(piece), F.lit(2))


def _bin(value: Column, *edges: float) -> Column:
    """How many of the edges a value reaches."""
    return reduce(lambda a, b: a + b, [F.when(value >= e, 1).otherwise(0) for e in edges])


def candidate(kind: Kind, index: int, m: Column, before: Column, after: Column) -> Column:
    """Features and distant label of a match."""
    n = F.length(m)
    letters = F.regexp_replace(m, "[^A-Za-z]", "")
    n_digits, n_upper = F.length(_digits(m)), F.length(F.regexp_replace(m, "[^A-Z]", ""))
    signs = n - n_digits - F.length(letters)
    edge = F.regexp_replace(before, "[\\x20\"'`]+$", "")
    label = F.lower(before).rlike(EVIDENCE[kind.name])
    if kind.name == "number":
        label |= n_digits.between(16, 19) & _luhn(_digits(m))
    return F.struct(
        label.cast("int").alias("label"),
        F.lit(index).alias("kind"), _bin(n, 12, 16, 20, 24, 32, 36, 40, 44, 64, 80).alias("length"),
        _bin(n_digits / n, 0.01, 0.15, 0.3, 0.45, 0.6, 0.8, 0.99).alias("digits"),
        _bin(n_upper / F.greatest(F.length(letters), F.lit(1)), 0.01, 0.3, 0.7, 0.99).alias("upper"),
        m.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$").cast("int").alias("hex"), _bin(signs, 1, 2, 3, 5, 8).alias("separators"),
        (F.right(before, F.lit(1)).isin('"', "'", "`") & F.left(after, F.lit(1)).isin('"', "'", "`"))
        .cast("int").alias("quoted"),
        F.right(edge, F.lit(1)).isin("=", ":").cast("int").alias("assigned"),
        F.left(after, F.lit(1)).rlike("[A-Za-z0-9]").cast("int").alias("cut"),
        (m.rlike("[0-9]") & m.rlike("[A-Za-z]")).cast("int").alias("mixed"))


def _as_candidate(kind: Kind, index: int):
    return lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"),
                              candidate(kind, index, c["m"], c["before"], c["after"]).alias("f"))


def _wide() -> Column:
    """The candidates of all generators, from their match columns: s, e, f."""
    return F.concat(*[F.transform(f"_{k.name}", _as_candidate(k, i)) for i, k in enumerate(WIDE)])


@dataclass
class Model:
    """Boosted trees of depth two: (feature, edge, [(feature, edge, low, high)] * 2), a start and each generator's threshold."""

    start: float
    trees: list
    thresholds: list[float]

    def margin(self, row: dict) -> float:
        total = self.start
        for f, at, sides in self.trees:
            g, to, low, high = sides[row[f] >= at]
            total += high if row[g] >= to else low
        return total

    def column(self, c: Column) -> Column:
        total = F.lit(self.start)
        for f, at, sides in self.trees:
            leaf = [F.when(c[g] >= to, F.lit(high)).otherwise(F.lit(low)) for g, to, low, high in sides]
            total = total + F.when(c[f] >= at, leaf[1]).otherwise(leaf[0])
        return total


def _stump(cells: list[dict]) -> tuple[float, str, int, float, float]:
    """The split of weighted cells with the largest gain, and Newton steps for its two sides."""
    g_all, h_all = sum(c["g"] for c in cells), sum(c["h"] for c in cells)
    best = (-1.0, FEATURES[0], 0, 0.0, 0.0)
    for f in FEATURES:
        by_value: dict[int, list[float]] = {}
        for c in cells:
            total = by_value.setdefault(c[f], [0.0, 0.0])
            total[0] += c["g"]
            total[1] += c["h"]
        gl = hl = 0.0
        for at in sorted(by_value):
            gh, hh = g_all - gl, h_all - hl
            gain = gl * gl / (hl + 1) + gh * gh / (hh + 1)
            if gain > best[0]:
                best = (gain, f, at, RATE * gl / (hl + 1), RATE * gh / (hh + 1))
            gl, hl = gl + by_value[at][0], hl + by_value[at][1]
    return best


def fit(cells: list[dict]) -> Model:
    """Boosted trees and thresholds from cells with features, ``held_out``, ``n`` candidates and ``pos`` positives.

    The trees see the cells that aren't held out; the held-out ones calibrate each generator's threshold (all cells,
    where fewer than ``LEAST`` of its positives are held out).
    """
    model = Model(0.0, [], [math.inf] * len(WIDE))
    learnt = [c for c in cells if not c["held_out"]]
    n, pos = sum(c["n"] for c in learnt), sum(c["pos"] for c in learnt)
    if not pos:
        return model
    model.start = math.log((pos + 0.5) / (n - pos + 0.5))
    for c in learnt:
        c["f"] = model.start
    for _ in range(TREES):
        for c in learnt:
            p = 1 / (1 + math.exp(-c["f"]))
            c["g"], c["h"] = c["pos"] - c["n"] * p, c["n"] * p * (1 - p)
        _, f, at, _, _ = _stump(learnt)
        sides = [_stump([c for c in learnt if (c[f] >= at) == side])[1:] for side in (False, True)]
        model.trees.append((f, at, sides))
        for c in learnt:
            g, to, low, high = sides[c[f] >= at]
            c["f"] += high if c[g] >= to else low
    for kind in range(len(WIDE)):
        own = [c for c in cells if c["kind"] == kind]
        held = [c for c in own if c["held_out"]]
        model.thresholds[kind] = _calibrated(model, held if sum(c["pos"] for c in held) >= LEAST else own)
    return model


def _calibrated(model: Model, cells: list[dict]) -> float:
    """The lowest margin, from the top down, as long as the positives' share holds."""
    taken = right = 0
    threshold = math.inf
    by_margin: dict[float, list[dict]] = {}
    for c in cells:
        by_margin.setdefault(round(model.margin(c), 6), []).append(c)
    for m in sorted(by_margin, reverse=True):
        taken, right = taken + sum(c["n"] for c in by_margin[m]), right + sum(c["pos"] for c in by_margin[m])
        if right >= PRECISION * taken:
            threshold = m
    return threshold


def learn(docs: DataFrame, text: str) -> Model:
    """The model of a corpus: one pass over all texts, one cell table of bounded size on the driver.

    A text's checksum decides whether its candidates are held out, so copies of a text fall on one side.
    """
    held = with_matches(docs.select(_plain(text).alias("_t")), WIDE, "_t")
    out = (F.crc32(F.encode("_t", "UTF-8")) % FOLDS == 0).alias("held_out")
    # outer: an inner explode would first filter on the array's size, and make the array twice
    cells = (held.select(out, F.explode_outer(_wide()).alias("c")).where("c is not null").select("held_out", "c.f.*")
             .groupBy("held_out", *FEATURES).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos"))
             .orderBy("held_out", *FEATURES))
    return fit([r.asDict() for r in cells.collect()])


def _plain(text: str) -> Column:
    """The text with the marks' characters replaced by another one that no pattern holds."""
    body = F.coalesce(F.col(text), F.lit(""))
    return F.when(body.contains(OPEN) | body.contains(SHUT), F.translate(body, OPEN + SHUT, OTHER + OTHER)).otherwise(body)


def _accepted(model: Model, c: Column) -> Column:
    found = F.lit(False)
    for kind, threshold in enumerate(model.thresholds):
        if not math.isinf(threshold):
            found = F.when(c["kind"] == kind, model.column(c) >= F.lit(threshold - 1e-5)).otherwise(found)
    return found


def _free(candidates: Column, spans: Column) -> Column:
    """The candidates that overlap none of ``spans`` (both with s, e): two walks over all of them, sorted by start.

    On the way forth a candidate meets the furthest end so far, on the way back the next start.
    """
    def walk(ordered: Column, start: Column, step) -> Column:
        begin = F.struct(start.alias("edge"), F.array().cast("array<struct<s:int,own:int,e:int>>").alias("kept"))
        return F.aggregate(ordered, begin, step)["kept"]

    def forth(acc: Column, x: Column) -> Column:
        clash = (x["own"] == 1) & (acc["edge"] > x["s"])
        return F.struct(F.when(x["own"] == 0, F.greatest(acc["edge"], x["e"])).otherwise(acc["edge"]).alias("edge"),
                        F.when(clash, acc["kept"]).otherwise(F.array_append(acc["kept"], x)).alias("kept"))

    def back(acc: Column, x: Column) -> Column:
        keep = (x["own"] == 1) & (acc["edge"] >= x["e"])
        return F.struct(F.when(x["own"] == 0, x["s"]).otherwise(acc["edge"]).alias("edge"),
                        F.when(keep, F.array_append(acc["kept"], x)).otherwise(acc["kept"]).alias("kept"))

    def marked(part: Column, own: int) -> Column:
        return F.transform(part, lambda c: F.struct(c["s"].alias("s"), F.lit(own).alias("own"), c["e"].alias("e")))

    ordered = F.array_sort(F.concat(marked(candidates, 1), marked(spans, 0)))
    left = walk(F.reverse(walk(ordered, F.lit(-1), forth)), F.lit((1 << 31) - 1), back)
    free = F.transform(F.reverse(left), lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e")))
    places = F.transform(candidates, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e")))
    return F.when((F.size(candidates) == 0) | (F.size(spans) == 0), places).otherwise(free)


def _with_spans(docs: DataFrame, model: Model, text: str) -> DataFrame:
    """Rows of ``docs`` as a struct ``_row``, their text ``_text``, and the places (s, e) of each kind's spans ``_<kind>``.

    An accepted candidate counts unless it overlaps a base span or an accepted candidate of an earlier generator.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{text}`").alias("_text"))
    held = with_matches(_set(rows, {"_t": _plain("_text")}), [*BASE, *WIDE], "_t")

    def place(c: Column) -> Column:
        return F.struct(c["s"].alias("s"), c["e"].alias("e"))

    def accepted(k: Kind, i: int) -> Column:
        scored = F.transform(f"_{k.name}", _as_candidate(k, i))
        return F.transform(F.filter(scored, lambda c: _accepted(model, c["f"])), place)

    held = _set(held, {f"_{k.name}": F.transform(F.filter(f"_{k.name}", _is_valid(k)), place) for k in BASE}
                | {f"_{k.name}": accepted(k, i) for i, k in enumerate(WIDE)})
    held = _set(held, {"_taken": F.concat(*[f"_{k.name}" for k in BASE])})
    held = _set(held, {f"_{k.name}": _free(F.col(f"_{k.name}"), F.col("_taken")) for k in WIDE})
    earlier = [f"_{k.name}" for k in WIDE]
    return _set(held, {n: _free(F.col(n), F.concat(*earlier[:i])) for i, n in enumerate(earlier) if i}, ("_taken",))


def find_spans(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add n_email, n_ip, n_card, n_phone, base_spans and spans (kind:start:end, comma-joined) to every row.

    Null and empty texts have none.  An accepted candidate counts unless it overlaps a base span or
    an accepted candidate of an earlier generator.  Columns of ``docs`` with these names are replaced.
    """
    added = [*[f"n_{k.name}" for k in BASE], "base_spans", "spans"]
    held = _with_spans(docs, model, text)

    def written_out(kind: Kind) -> Column:
        return F.transform(f"_{kind.name}", lambda c: F.concat_ws(
            ":", F.lit(kind.name), c["s"].cast("string"), c["e"].cast("string")))

    return held.select(*[F.col(f"_row.`{c}`") for c in docs.columns if c not in added],
                       *[F.size(f"_{k.name}").cast("bigint").alias(f"n_{k.name}") for k in BASE],
                       F.array_join(F.concat(*map(written_out, BASE)), ",").alias("base_spans"),
                       F.array_join(F.concat(*map(written_out, [*BASE, *WIDE])), ",").alias("spans"))


def _merged(spans: Column) -> Column:
    """Disjoint regions (s, e, k) of sorted spans: overlapping ones are one, named by the earliest kind of them."""
    def add(acc: Column, x: Column) -> Column:
        region = F.struct(acc["s"].alias("s"), acc["e"].alias("e"), acc["k"].alias("k"))
        meets = x["s"] < acc["e"]
        return F.struct(
            F.when(meets | acc["done"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], region)).alias("done"),
            F.when(meets, acc["s"]).otherwise(x["s"]).alias("s"),
            F.when(meets, F.greatest(acc["e"], x["e"])).otherwise(x["e"]).alias("e"),
            F.when(meets, F.least(acc["k"], x["k"])).otherwise(x["k"]).alias("k"))

    first = F.get(spans, F.lit(0))
    begin = F.struct(F.array().cast("array<struct<s:int,e:int,k:int>>").alias("done"), first["s"].alias("s"),
                     first["e"].alias("e"), first["k"].alias("k"))
    return F.aggregate(spans, begin, add, lambda acc: F.array_append(
        acc["done"], F.struct(acc["s"].alias("s"), acc["e"].alias("e"), acc["k"].alias("k"))))


def redact(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` that ``find_spans`` reports replaced by its kind in brackets.

    Overlapping spans are replaced together, by the earliest of their kinds.  All other text stays as it is; null stays
    null.  A text is put together block by block, so that no span costs a walk through the whole text.
    """
    kinds = [*BASE, *WIDE]
    held = _with_spans(docs, model, text)

    def numbered(i: int):
        return lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), F.lit(i).alias("k"))

    every = F.concat(*[F.transform(f"_{k.name}", numbered(i)) for i, k in enumerate(kinds)])
    held = _set(held, {"_r": F.array_sort(every)}, tuple(f"_{k.name}" for k in kinds))
    held = _set(held, {"_r": F.when(F.size("_r") > 0, _merged(F.col("_r"))), "_n": F.greatest(
        F.lit(1 << 13), F.ceil(F.length("_text") / 64).cast("int"))})
    names = F.array(*[F.lit(f"[{k.name.upper()}]") for k in kinds])

    def block(b: Column) -> Column:
        lo = b * F.col("_n")
        of = F.struct(F.substr(F.col("_text"), lo + 1, F.col("_n")).alias("t"),
                      F.filter("_r", lambda r: (r["s"] < lo + F.col("_n")) & (r["e"] > lo)).alias("r"))

        def swapped(x: Column) -> Column:
            def part(r: Column, i: Column) -> Column:
                last = F.greatest(F.coalesce(F.get(x["r"], i - 1)["e"], lo), lo)
                name = F.when(r["s"] >= lo, F.get(names, r["k"])).otherwise("")
                return F.concat(F.substr(x["t"], last - lo + 1, F.greatest(r["s"] - last, F.lit(0))), name)

            end = F.coalesce(F.get(x["r"], F.size(x["r"]) - 1)["e"], lo)
            return F.concat(F.array_join(F.transform(x["r"], part), ""), F.substr(
                x["t"], end - lo + 1, F.greatest(F.col("_n") - (end - lo), F.lit(0))))

        # a one-element array binds the block's text and regions once
        return F.get(F.transform(F.array(of), swapped), F.lit(0))

    blocks = F.sequence(F.lit(0), F.floor((F.length("_text") - 1) / F.col("_n")).cast("int"))
    clean = F.when(F.col("_r").isNull(), F.col("_text")).otherwise(F.array_join(F.transform(blocks, block), ""))
    return held.withColumn("_clean", clean).select(
        *[F.col("_clean").alias(text) if c == text else F.col(f"_row.`{c}`") for c in docs.columns])
