"""Jobs on the driver whose few result rows are stored as soon as each has ended."""

from __future__ import annotations

import threading
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import exists


def recorded_jobs(spark: SparkSession, jobs: dict[tuple, Callable[[], list[tuple]]], path: str, schema: str, key: list[str], parallel: int = 1) -> DataFrame:
    """The rows of all jobs, each written as soon as its job has ended.

    A job gives a few rows that begin with its key. Up to ``parallel`` jobs run at a time, their Spark jobs side by side.
    Jobs whose rows are at ``path`` already are not run again, so a run that was stopped goes on where it was.
    """
    done = set()
    if exists(spark, path):
        done = {tuple(r) for r in spark.read.schema(schema).parquet(path).select(*key).distinct().collect()}
    lock = threading.Lock()

    def run(job: Callable[[], list[tuple]]) -> None:
        rows = job()
        with lock:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)

    with ThreadPoolExecutor(parallel) as pool:
        # a failed job is raised when the others have ended and are recorded
        for ended in [pool.submit(run, job) for k, job in jobs.items() if k not in done]:
            ended.result()
    wanted = spark.createDataFrame(list(jobs), ", ".join(f.strip() for f in schema.split(",")[: len(key)]))
    return spark.read.schema(schema).parquet(path).join(wanted, key, "left_semi")
