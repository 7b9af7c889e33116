"""What a run ran on, as one row."""

from __future__ import annotations

import os
import platform
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def run_environment(spark: SparkSession, repo: str = ".") -> DataFrame:
    def git(*args: str) -> str | None:
        try:
            return subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True, timeout=10, check=True).stdout.strip()
        except (OSError, subprocess.SubprocessError):
            return None

    dirty = git("status", "--porcelain")
    row = (git("rev-parse", "HEAD"), None if dirty is None else bool(dirty), spark.version, platform.python_version(), f"{platform.system()} {platform.release()}", platform.processor() or platform.machine(), os.cpu_count(), os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES"))
    out = spark.createDataFrame([row], "git_commit string, git_dirty boolean, spark_version string, python_version string, os string, cpu string, cores int, memory_bytes long")
    return out.withColumn("started_at", F.current_timestamp())
