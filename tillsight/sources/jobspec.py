"""Job specifications (S7): one JSON document per job, validated in one pass.

A spec names the job, its type (``report`` or ``delta``), its input files and optional
column mapping, tenant config, product map rows, category margins and delta config.
Specs are read with an explicit schema; ``violations`` lists what a worker would reject.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillsight.config import CATEGORY_PRESETS, COLUMN_ALIASES, STORE_FIELDS

JOB_TYPES = ("report", "delta")

MAP_ROW = T.StructType([T.StructField(c, T.StringType()) for c in
                        ("sistema", "precio_post", "fecha_desde", "nombre", "categoria", "subcategoria", "margen_pct")])
JOB_SPEC_SCHEMA = T.StructType([
    T.StructField("job_id", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("store_id", T.StringType()),
    T.StructField("input_files", T.ArrayType(T.StringType())),
    T.StructField("column_mapping", T.MapType(T.StringType(), T.StringType())),
    T.StructField("tenant_config", T.MapType(T.StringType(), T.StringType())),
    T.StructField("product_map", T.ArrayType(MAP_ROW)),
    T.StructField("category_margins", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("delta_config", T.MapType(T.StringType(), T.StringType())),
])


def read_job_specs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(JOB_SPEC_SCHEMA).option("multiLine", False).json(path)


def store_configs(specs: DataFrame, key: str = "store_id") -> DataFrame:
    """One row per ``key`` with the columns of :data:`tillsight.config.STORE_FIELDS` (null where not set or unreadable),
    ``category_map``, ``columns`` (aliases by role), ``currency`` and ``ignored`` (keys that mean nothing).

    ``category_normalization`` (or ``category_map``) is a JSON map, or the name of a fixed map (``report``, ``delta``).
    """
    given = F.coalesce("tenant_config", F.create_map().cast("map<string,string>"))

    def value(name: str, kind: str) -> Column:
        text = F.col("_given")[name]
        return F.from_json(text, kind) if kind.startswith(("array", "map")) else text.try_cast(kind)

    written = F.coalesce(F.col("_given")["category_normalization"], F.col("_given")["category_map"])
    maps = F.from_json(written, "map<string,string>")
    for name, fixed in CATEGORY_PRESETS.items():
        pairs = F.create_map(*[F.lit(x) for kv in fixed.items() for x in kv])
        maps = F.when(F.btrim(written, F.lit('"')) == name, pairs).otherwise(maps)
    aliases = F.map_filter(value("columns", "map<string,string>"), lambda role, _: role.isin(*COLUMN_ALIASES))
    known = [*STORE_FIELDS, "category_normalization", "category_map", "columns", "currency", "store_name"]
    return specs.withColumn("_given", given).select(
        key, *[value(n, t).alias(n) for n, t in STORE_FIELDS.items()], maps.alias("category_map"), aliases.alias("columns"),
        F.col("_given")["currency"].alias("currency"),
        F.array_sort(F.array_except(F.map_keys("_given"), F.array(*[F.lit(k) for k in known]))).alias("ignored"))


def violations(specs: DataFrame) -> DataFrame:
    """Per spec: the list of problems (empty = valid): missing job_id / type /
    input_files, unknown type, empty input list."""
    problems = F.array_compact(F.array(
        F.when(F.col("job_id").isNull() | (F.trim("job_id") == ""), F.lit("missing job_id")),
        F.when(F.col("type").isNull(), F.lit("missing type")),
        F.when(F.col("type").isNotNull() & ~F.col("type").isin(*JOB_TYPES), F.format_string("unknown type %s", "type")),
        F.when(F.col("input_files").isNull(), F.lit("missing input_files")),
        F.when(F.size("input_files") == 0, F.lit("empty input_files")),
    ))
    return specs.select("job_id", "store_id", "type", problems.alias("problems"), (F.size(problems) == 0).alias("valid"))


def category_margin_table(specs: DataFrame) -> DataFrame:
    """(store_id, category, margin_pct) rows from the specs' category margins (J22 input)."""
    return specs.select("store_id", F.explode("category_margins").alias("category", "margin_pct"))
