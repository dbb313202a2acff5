"""Preference formatting with DataFrame functions only: a shared prompt and two masked completions.

A pair has a chosen and a rejected conversation.  Their longest common prefix of turns (same role
and text) is rendered once as the prompt; the turns behind it are the two completions.  A
completion's mask gives the lengths of its stretches of characters and whether a model is trained
on them: the text and the end sign of every assistant turn are.

One shuffle brings a pair's turns together; conversations are only as large as a record
of the output.  No pair is formed by a join, and no two conversations meet but the two of a pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>\n"
TRAINED = "assistant"


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def _rendered(turn: Column) -> Column:
    return F.concat(_head(turn), turn["text"], F.lit(END))


def _joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _same(a: Column, b: Column) -> Column:
    return F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False))


def _mask(turns: Column) -> Column:
    """``length:flag`` of the stretches of a rendered completion, comma-joined; flag 1 is trained."""
    def stretch(turn: Column) -> Column:
        head, body = F.length(_head(turn)), F.length(turn["text"]) + len(END)
        return F.when(turn["role"] == TRAINED, F.concat(head.cast("string"), F.lit(":0,"), body.cast("string"), F.lit(":1"))
                      ).otherwise(F.concat((head + body).cast("string"), F.lit(":0")))

    return F.array_join(F.transform(turns, stretch), ",")


def format_pairs(turns: DataFrame, pair: str = "pair_id", side: str = "side", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """One row per pair: prompt, prompt_turns, chosen, chosen_mask, rejected, rejected_mask.

    ``turns`` has a row per turn, ``side`` 0 for chosen and 1 for rejected.  Turns are ordered by number,
    ties by role and text, so repeated rows stay as repeated turns; null roles and
    texts count as empty.  A side without turns gives a null completion and mask, and then the prompt is
    empty; two equal conversations give empty completions.  Rows with a null pair are one pair more.
    """
    rows = turns.select(F.col(pair).alias("pair"), F.col(side).alias("side"), F.col(turn).alias("turn"),
                        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    packed = rows.groupBy("pair").agg(F.sort_array(F.collect_list(F.struct("side", "turn", "role", "text"))).alias("t"))
    packed = packed.select("pair", F.filter("t", lambda t: t["side"] == 0).alias("c"),
                           F.filter("t", lambda t: t["side"] == 1).alias("r"))
    both = F.least(F.size("c"), F.size("r"))
    places = F.when(both > 0, F.sequence(F.lit(0), both - 1)).otherwise(F.array().cast("array<int>"))
    differ = F.filter(places, lambda i: ~_same(F.get("c", i), F.get("r", i)))
    packed = packed.withColumn("n", F.coalesce(F.get(differ, F.lit(0)), both))
    packed = packed.select("*", F.slice("c", F.lit(1), F.col("n")).alias("p"),
                           *[F.slice(x, F.col("n") + 1, F.size(x)).alias(f"{x}_rest") for x in ("c", "r")])
    shown = [F.when(F.size(x) > 0, v).alias(name) for x, side_name in (("c", "chosen"), ("r", "rejected"))
             for name, v in ((side_name, _joined(F.col(f"{x}_rest"))),
                             (f"{side_name}_mask", _mask(F.col(f"{x}_rest"))))]
    return packed.select(F.col("pair").alias(pair), _joined(F.col("p")).alias("prompt"),
                         F.col("n").cast("bigint").alias("prompt_turns"), *shown)


ORACLE = """
WITH t AS (SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, list({'turn': turn, 'role': coalesce(role, ''),
             'text': coalesce(text, '')} ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS l
           FROM conversations GROUP BY ALL),
j AS (SELECT pair_id, max(l) FILTER (side = 0) AS c, max(l) FILTER (side = 1) AS r FROM t GROUP BY pair_id),
n AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(c), len(r)) + 1),
             lambda i: c[i].role <> r[i].role OR c[i].text <> r[i].text)) - 1, least(len(c), len(r)), 0)
      * CASE WHEN c IS NULL OR r IS NULL THEN 0 ELSE 1 END AS n FROM j),
p AS (SELECT pair_id, n, c[:n] AS p, c[n + 1:] AS c, r[n + 1:] AS r FROM n),
s AS (SELECT *, list_transform(p, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)) AS ps,
        list_transform(c, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)) AS cs,
        list_transform(r, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)) AS rs FROM p)
SELECT pair_id, coalesce(array_to_string(ps, ''), '') AS prompt, CAST(n AS BIGINT) AS prompt_turns,
  CASE WHEN c IS NOT NULL THEN coalesce(array_to_string(cs, ''), '') END AS chosen,
  CASE WHEN c IS NOT NULL THEN coalesce(array_to_string(list_transform(c, lambda x: CASE WHEN x.role = 'assistant'
    THEN (length(x.role) + 5)::VARCHAR || ':0,' || (length(x.text) + 8)::VARCHAR || ':1'
    ELSE (length(x.role) + length(x.text) + 13)::VARCHAR || ':0' END), ','), '') END AS chosen_mask,
  CASE WHEN r IS NOT NULL THEN coalesce(array_to_string(rs, ''), '') END AS rejected,
  CASE WHEN r IS NOT NULL THEN coalesce(array_to_string(list_transform(r, lambda x: CASE WHEN x.role = 'assistant'
    THEN (length(x.role) + 5)::VARCHAR || ':0,' || (length(x.text) + 8)::VARCHAR || ':1'
    ELSE (length(x.role) + length(x.text) + 13)::VARCHAR || ':0' END), ','), '') END AS rejected_mask
FROM s"""
