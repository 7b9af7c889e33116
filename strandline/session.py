"""Sessions: the package's Python code on the executors, and tables in the shared scratch folder."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from contextlib import suppress
from functools import wraps
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_sent: set[str] = set()
_scratch: set[str] = set()


#: Bytes of an Arrow batch, where the application doesn't set them: what a worker holds of its input is bounded however long rows are.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, so that workers needn't have it installed; bounds Arrow batches."""
    if not spark.sparkContext.getConf().contains(BATCH[0]):
        spark.conf.set(BATCH[0], str(BATCH[1]))
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    root = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="strandline-")) / "strandline.zip"
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    spark.sparkContext.addPyFile(str(to))
    _sent.add(app)


def shipped(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """query(spark, ...) with the package shipped first."""

    @wraps(query)
    def run(spark: SparkSession, *args, **kwargs) -> DataFrame:
        ship(spark)
        return query(spark, *args, **kwargs)

    return run


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder for intermediate tables, deleted when it ends: below spark.checkpoint.dir, or below a local
    folder where that is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="strandline-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
    path = f"{found.rstrip('/')}/strandline-{spark.sparkContext.applicationId}"
    if path not in _scratch:
        _scratch.add(path)
        atexit.register(_end, spark, path)
    return path


def _end(spark: SparkSession, path: str) -> None:
    with suppress(Exception):  # the JVM may be gone before
        delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as a DataFrame, by way of Arrow: rows of Python objects would start workers of their own on every executor, which stay."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(arrow)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet in the shared scratch folder and reads it back."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the table of a materialised frame that nothing reads any more; other frames are left alone."""
    if path := getattr(df, "_scratch", None):
        delete(df.sparkSession, path)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files that nothing reads any more: it does so when the driver collects garbage, which has little of its own."""
    gc.collect()
    spark._jvm.System.gc()
