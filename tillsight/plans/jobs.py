"""Jobs from specifications (S7, N5, N6): every spec is a row, all of them run in one set of plans.

Specs are checked, their files found, mapped and scanned once; a job whose spec, files or columns can't be used becomes a
result row that says why, and the other jobs' lines go on together, keyed by job id where the operators say store.
Sales-report and event-impact jobs share everything up to the sanitized lines.  Event jobs differ by event date,
selection and window: the first two are tables, the window (7, 14 or 30 days) shapes the plan, so each of the
three has a plan of its own, however many jobs there are.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillsight.config import DELTA_ROLLING_WIDTH, DeltaConfig, StoreConfigs
from tillsight.operators import clean, delta
from tillsight.plans.report import ReportJob
from tillsight.session import scratch_table_path
from tillsight.sources import jobspec, landing, sinks
from tillsight.sources.bindings import written

DELTA_MODULES = {
    "delta_meta": delta.meta, "delta_kpis": delta.rounded_kpis, "delta_timeline": delta.timeline,
    "delta_products": delta.product_impact, "delta_categories": delta.category_mix,
    "delta_warnings": delta.coverage_and_warnings, "delta_top_products": delta.top_products, "delta_orders": delta.order_frame}
RESULT = ("job_id string, store_id string, type string, status string, error string, input_rows bigint, "
          "normalized_rows bigint, discarded_rows bigint")


def _job_files(specs: DataFrame, files: DataFrame) -> DataFrame:
    """(job_id, input, mapping) of every input with the files at or under it (a null path: none)."""
    inputs = specs.select("job_id", F.col("column_mapping").alias("mapping"), F.explode("input_files").alias("input"))
    inputs = inputs.withColumn("input", F.rtrim(F.regexp_replace("input", "^file:/+", "/"), F.lit("/")))
    steps = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    return inputs.join(files.withColumn("input", F.explode(above)), "input", "left")


def _problems(specs: DataFrame, job_files: DataFrame, maps: DataFrame) -> DataFrame:
    """(job_id, error) of the jobs that can't run, all their problems in one text."""
    def said(df: DataFrame, text) -> DataFrame:
        return df.select("job_id", text.alias("problem"))

    every = [
        said(jobspec.violations(specs).where("not valid").select("job_id", F.explode("problems").alias("p")), F.col("p")),
        said(job_files.where("path is null"), F.concat(F.lit("input no encontrado: "), "input")),
        said(job_files.where("error is not null"), F.concat(F.lit("input ilegible: "), "path", F.lit(": "), "error")),
        said(maps.where(F.size("missing") > 0), F.concat(F.lit("faltan columnas tras aplicar el mapeo: "),
                                                        F.array_join("missing", ", "))),
    ]
    return reduce(DataFrame.unionByName, every).groupBy("job_id").agg(
        F.array_join(F.sort_array(F.collect_set("problem")), "; ").alias("error"))


def run_specs(spark: SparkSession, specs: DataFrame, out_dir: str | None = None, report_modules: list[str] | None = None,
              delta_modules: list[str] | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Run all jobs of ``specs`` (see ``sources.jobspec``; job ids are unique, inputs are files or folders).

    Returns one result row per spec (``RESULT``) and the written modules, partitioned by job (column ``store_id``).
    ``report_modules`` and ``delta_modules`` name those to write (default: all).
    """
    out = out_dir or scratch_table_path(spark, f"jobs-{ReportJob(spark).run_id}")
    specs = written(specs, "specs")
    inputs = [r[0] for r in specs.select(F.explode("input_files")).distinct().collect()]  # the listing of the jobs' folders
    scan = landing.scan(spark, inputs)
    files = written(_job_files(specs, scan.files), "job-files")
    maps = written(landing.mappings(files.where("path is not null")), "job-maps")
    failed = written(_problems(specs, files, maps), "failed")
    running = specs.join(failed, "job_id", "left_anti")
    rows = landing.canonical_rows(scan, maps.join(running.select("job_id"), "job_id", "left_semi"), F.col("job_id"))

    of_job = running.withColumn("store_id", F.col("job_id"))
    product_map = of_job.select("store_id", F.posexplode("product_map").alias("map_seq", "row")).select(
        "store_id", F.col("map_seq").cast("bigint").alias("map_seq"), "row.*")
    margins = jobspec.category_margin_table(of_job)
    cfg = StoreConfigs(table=written(jobspec.store_configs(of_job), "configs"))
    job = ReportJob(spark, cfg)
    text = job.normalize(rows, product_map, margins)  # a scan of the numbered lines
    lines, discarded, quality = job.lines(text)

    counts = (rows.groupBy("store_id").agg(F.count(F.lit(1)).alias("input_rows"))
              .join(quality.select("store_id", F.col("initial_rows").alias("normalized_rows"),
                                   F.col("dropped_rows").alias("discarded_rows"), "valid_rows"), "store_id", "left"))
    counts = written(counts.withColumnRenamed("store_id", "job_id"), "counts")
    empty = counts.where("valid_rows = 0").select("job_id", F.lit("sin filas válidas").alias("error"))
    failed = failed.unionByName(empty)
    done = of_job.join(failed.select("job_id"), "job_id", "left_anti")

    modules: dict[str, DataFrame] = {}
    reports = written(done.where("type = 'report'").select("store_id"), "reports")
    names = report_modules if report_modules is not None else list(job.modules(lines, quality))
    if names:
        modules |= job.run_some(lines.join(reports, "store_id", "left_semi"),
                                quality.join(reports, "store_id", "left_semi"), names, f"{out}/report")
    events = done.where("type = 'delta'").select(
        "store_id", F.coalesce(F.col("delta_config")["window_days"].try_cast("int"), F.lit(14)).alias("window"),
        F.col("delta_config")["event_date"].alias("event_date"), F.col("delta_config")["as_of"].alias("as_of"),
        F.from_json(F.col("delta_config")["selected_products"], "array<string>").alias("selected"))
    events = written(events, "events")
    wanted = delta_modules if delta_modules is not None else list(DELTA_MODULES)
    parts: dict[str, list[DataFrame]] = {n: [] for n in wanted}
    for days in DELTA_ROLLING_WIDTH:
        mine = events.where(F.col("window") == days)
        own = lines.join(mine.select("store_id"), "store_id", "left_semi")
        at = replace(DeltaConfig(window_days=days), table=mine, selection=mine.select(
            "store_id", F.explode("selected").alias("product")))
        for n in wanted:
            parts[n].append(DELTA_MODULES[n](own, at))
    for n, each in parts.items():
        whole = reduce(DataFrame.unionByName, each)
        sinks.write_module(whole, f"{out}/delta/{n}")
        modules[n] = spark.read.schema(whole.schema).parquet(f"{out}/delta/{n}")
    sinks.write_discarded(discarded.join(done.select("store_id"), "store_id", "left_semi"), f"{out}/discarded")

    result = (specs.select("job_id", "store_id", "type").join(failed, "job_id", "left").join(counts, "job_id", "left")
              .select("job_id", "store_id", "type", F.when(F.col("error").isNull(), "succeeded").otherwise("failed").alias("status"),
                      "error", *[F.when(F.col("error").isNull(), F.col(c)).alias(c)
                                 for c in ("input_rows", "normalized_rows", "discarded_rows")]))
    return result, modules
