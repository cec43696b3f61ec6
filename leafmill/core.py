"""Reading tables and cutting lineage.

``materialize`` writes an intermediate result once, as Parquet, into the folder all executors share
(``spark.checkpoint.dir``) and reads it back, so that a lost executor costs a re-read and not the whole lineage, and so
that an expensive Python stage that feeds several consumers runs once.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from contextlib import suppress

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []
_WRITTEN: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate results: the session's ``spark.checkpoint.dir``, else the folder set for its checkpoints;
    a temporary one only where both are unset on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and (found := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        base = found.get()
    if base:
        return base.rstrip("/")
    if not re.match(r"local(?:\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="leafmill-"))
        atexit.register(shutil.rmtree, _OWN[0], True)
    return "file://" + _OWN[0]


def session_dir(spark: SparkSession) -> str:
    """The application's own folder below the shared one; ``clean_up`` removes it, at the latest when Python ends."""
    path = f"{shared_dir(spark)}/leafmill/{spark.sparkContext.applicationId}"
    if path not in _WRITTEN:
        if not _WRITTEN:
            atexit.register(clean_up)
        _WRITTEN[path] = spark
    return path


def clean_up() -> None:
    """Remove what this process has written to the shared folder; results that were not read yet are lost with it."""
    for path, spark in list(_WRITTEN.items()):
        del _WRITTEN[path]
        with suppress(Exception):  # the session may have ended
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Rows with whole texts that a Python stage takes at once, so that long texts need little memory.
FEW_ROWS = 256


def materialize(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of it. Rows and column types stay as they are.

    ``rows`` limits what Python stages of this plan take at once; the session's setting is back afterwards.
    """
    spark = df.sparkSession
    path = f"{session_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    if rows and not 0 < int(before) < rows:
        spark.conf.set(setting, str(rows))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(df.schema).parquet(path)


#: Repeated keys that are named in a broadcast; more are joined.
MOST_NAMED = 100_000


def once(df: DataFrame, *keys: Column) -> DataFrame:
    """``df`` with one row for each key; rows whose key is null all stay.

    For stored tables keys alone tell which rows are repeated, so no whole row is shuffled: of a repeated key one stored row
    is named, by file and row, and the others are left out by a broadcast, or by a join on the key if too many are repeated.
    """
    named_keys = [k.alias(f"_key{i}") for i, k in enumerate(keys)]
    names = [f"_key{i}" for i in range(len(keys))]
    try:
        stored = df.select("*", *named_keys, F.struct("_metadata.file_path", "_metadata.row_index").alias("_at"))
    except AnalysisException:  # not read from files
        keyed = df.select("*", *named_keys)
        whole = keyed.dropDuplicates(names).where(" AND ".join(f"{n} IS NOT NULL" for n in names))
        return whole.unionByName(keyed.where(" OR ".join(f"{n} IS NULL" for n in names))).drop(*names)
    counted = stored.groupBy(*names).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    repeated = counted.where("_n > 1").select(*names, "_first")
    few = repeated.limit(MOST_NAMED + 1).collect()
    if len(few) > MOST_NAMED:
        marked = stored.join(repeated.hint("merge"), names, "left")
    else:
        marked = stored.join(F.broadcast(df.sparkSession.createDataFrame(few, repeated.schema)), names, "left")
    return marked.where("_first IS NULL OR _at = _first").drop(*names, "_at", "_first")


#: Tables up to this size may be dealt out to all cores before a Python stage.
SMALL = 256 << 20


def spread(df: DataFrame, source: DataFrame) -> DataFrame:
    """``df``, dealt out to all cores if the stored ``source`` it comes from is small and has fewer parts than there are
    cores, as one small file has. Anything larger stays in the parts that it is stored in and is not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size <= SMALL and source.rdd.getNumPartitions() < cores else df
