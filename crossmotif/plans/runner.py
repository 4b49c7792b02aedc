"""Runs grids of queries over inputs, skips what is done, and measures wall time, rows, bytes and memory."""

from __future__ import annotations

import json
import resource
import time
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossmotif.plans.catalog import Query

MEASURES = "query string, input string, status string, seconds double, rows long, driver_mb double, message string"


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def run_grid(spark: SparkSession, known: dict[str, Query], names: Iterable[str], inputs: Iterable[str], out: str, resume: bool = True) -> DataFrame:
    """Write each named query over each input below ``out`` and return one row of measures per run.

    With ``resume`` a result that was completed before is left as it is (status ``skipped``). A query that fails is
    recorded with its message and the others go on.
    """
    rows = []
    for sf_dir in inputs:
        label = sf_dir.rstrip("/").rsplit("/", 1)[-1]
        for name in names:
            path = f"{out}/{label}/{name}"
            if resume and _exists(spark, f"{path}/_SUCCESS"):
                rows.append((name, label, "skipped", 0.0, None, None, None))
                continue
            began = time.perf_counter()
            try:
                known[name](spark, sf_dir).write.mode("overwrite").parquet(path)
                count, status, message = spark.read.parquet(path).count(), "done", None
            except Exception as error:  # recorded; the grid goes on
                count, status, message = None, "failed", str(error)[:500]
            peak = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
            rows.append((name, label, status, time.perf_counter() - began, count, peak, message))
    return spark.createDataFrame(rows, MEASURES)


def roll_up(measures: DataFrame) -> DataFrame:
    """Runs, failures, total and largest seconds and peak memory of each query."""
    done = F.col("status") == "done"
    return measures.groupBy("query").agg(
        F.count(F.when(done, 1)).alias("runs"), F.count(F.when(F.col("status") == "failed", 1)).alias("failures"), F.sum(F.when(done, F.col("seconds"))).alias("seconds"),
        F.max(F.when(done, F.col("seconds"))).alias("longest"), F.max("driver_mb").alias("peak_mb"),
    )


def scale_ratios(measures: DataFrame, smallest: str) -> DataFrame:
    """Seconds of each query and input over those of the smallest input."""
    base = measures.where((F.col("input") == smallest) & (F.col("status") == "done")).select("query", F.col("seconds").alias("base"))
    return measures.where("status = 'done'").join(base, "query").select("query", "input", "seconds", (F.col("seconds") / F.col("base")).alias("ratio"))


def as_json(measures: DataFrame) -> str:
    return json.dumps([r.asDict() for r in measures.collect()])  # a row per run
