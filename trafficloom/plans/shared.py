"""Lineage cut through tables in the folder that all executors share.

``spark.checkpoint.dir`` names that folder. Only where it is unset *and* Spark
runs inside this one process (tests, a laptop) a temporary folder is used.

All tables of an application lie in one folder below it. A result is lazy, so the tables that it
reads stay until clean() is called, or the program ends in the ordinary way; temporary() deletes those
that a step made once its own result is written.
"""

from __future__ import annotations

import atexit
import io
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
#: Paths of the tables that were made and not released, in order.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the cluster's shared folder, which is read from the session."""
    app = spark.sparkContext.applicationId
    if app not in _own:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = base or "file://" + tempfile.mkdtemp(prefix="trafficloom-")
        _own[app] = f"{base.rstrip('/')}/trafficloom/{app}"
        atexit.register(_clean_at_exit, spark, app)
    return _own[app]


#: Most bytes of an Arrow batch that goes to a Python worker, unless the session says otherwise.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the bytes of Arrow batches in this session where they are at Spark's default (64 MB), which long texts would fill."""
    default = spark._jvm.org.apache.spark.sql.internal.SQLConf().getConfString(_BATCH_SETTING)
    if spark.conf.get(_BATCH_SETTING) == default:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


#: Spark's setting that deletes the shuffle files of an execution when it ends.
_SHUFFLE_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _write(df: DataFrame, path: str) -> None:
    """Write df as Parquet, and delete the shuffle files of that: nothing reads them again, and else they stay until the driver collects its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(_SHUFFLE_SETTING)
    conf.set(_SHUFFLE_SETTING, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(_SHUFFLE_SETTING, before)


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    The result has no lineage to df's inputs, survives lost executors and is
    read with column pruning. Every column becomes nullable.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _write(df, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    _made.append(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(df: DataFrame) -> None:
    """Delete the table behind a DataFrame that materialize() returned."""
    path = getattr(df, "_shared_path", None)
    if path:
        _delete(df.sparkSession, path)
        _made[:] = [p for p in _made if p != path]


@contextmanager
def temporary(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes the tables made inside when it ends well, but for those put into the list that it gives."""
    before, kept = set(_made), []
    yield kept
    stay = before | {df._shared_path for df in kept}
    for path in [p for p in _made if p not in stay]:
        _delete(spark, path)
        _made.remove(path)


def clean(spark: SparkSession) -> None:
    """Delete all tables of this application; results that read them are void."""
    app = spark.sparkContext.applicationId
    if app in _own:
        _delete(spark, _own[app])
        _made[:] = [p for p in _made if not p.startswith(_own[app] + "/")]


def _clean_at_exit(spark: SparkSession, app: str) -> None:
    try:
        _delete(spark, _own[app])
    except Exception:  # noqa: BLE001 - the session may be gone by then; the folder's owner cleans up
        pass


@contextmanager
def text_file(spark: SparkSession, path: str) -> Iterator[io.TextIOBase]:
    """A UTF-8 text file for writing at any path that the cluster's file systems know."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)

    class Raw(io.RawIOBase):
        def writable(self) -> bool:
            return True

        def write(self, data) -> int:
            stream.write(bytearray(data))
            return len(data)

    out = io.TextIOWrapper(io.BufferedWriter(Raw(), 1 << 20), encoding="utf-8", newline="\n")
    try:
        yield out
        out.flush()
    finally:
        stream.close()


def numbered(df: DataFrame, columns: list[str], name: str = "__uid") -> DataFrame:
    """columns of df and ``name``, a struct that is unique for each row and the same in every later plan.

    Unlike monotonically_increasing_id(), which follows the splits and so the number of cores
    that Spark sees while it plans, it names the row's place: file (a hash of its path)
    and index in the file. What is not a plain scan of files is written first.
    """
    def named(files: DataFrame) -> DataFrame:
        place = files.metadataColumn("_metadata")
        return files.select(*columns, F.struct(F.xxhash64(place["file_path"]).alias("file"), place["row_index"].alias("row")).alias(name))

    if df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        try:
            return named(df)
        except AnalysisException:  # files without a row index
            pass
    return named(materialize(df.select(*columns), "rows"))
