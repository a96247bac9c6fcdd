"""Session helpers: where shared scratch tables go, and how they are written."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where that is unset and all of Spark is one local process (tests, the
    bench) a temporary folder is made, and it is remembered in the session so
    that one session uses one folder. On a cluster a machine's own folder would
    be no shared one, so there an unset folder is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="marquee-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/marquee/{uuid.uuid4().hex}/{name}"


def materialise(df: DataFrame, name: str, drop_shuffles: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation.
    ``drop_shuffles``: the shuffle files of the write go as soon as it is done,
    and don't stay until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    try:
        if drop_shuffles:
            spark.conf.set(key, "true")
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def remove(*tables: DataFrame) -> None:
    """Delete the files of tables that ``materialise`` wrote; nothing may read them any more."""
    for df in tables:
        spark = df.sparkSession
        jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
            if path.getParent().getParent().getName() != "marquee":
                raise ValueError(f"{folder} is no scratch table")
            path.getFileSystem(conf).delete(path, True)


#: Bytes of text that a core may get by files alone.
SPREAD_BYTES = 64 << 20


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` on all cores: a table of few partitions is dealt out before work that is heavy for its size; a large one stays where it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    # The planner's estimate needs no plan to run, nor to be made ready to run.
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size < cores * SPREAD_BYTES else rows


def short_methods(spark: SparkSession) -> None:
    """In this session, plans whose generated methods are over 8,000 bytes run as split ones: Java compiles no longer method, but interprets it."""
    key = "spark.sql.codegen.hugeMethodLimit"
    spark.conf.set(key, min(int(spark.conf.get(key)), 8000))


def small_batches(spark: SparkSession, rows: int) -> None:
    """At most ``rows`` rows a batch between Java and Python in this session."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
