"""Session construction and lineage-cut helpers."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, app: str = "tavola",
                shuffle_partitions: int | None = None, driver_memory: str = "16g") -> SparkSession:
    """Build (or reuse) a session with the settings every job here assumes.

    AQE is on so that small join sides become broadcasts only after their
    runtime size is known, skewed shuffle partitions are split, and shuffle
    partition counts are coalesced.  Nothing here broadcasts a side whose
    size grows with the data unless Spark's own size check allows it.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
        if master.startswith("local"):
            # local mode: the driver JVM is the only executor
            b = b.config("spark.driver.memory", driver_memory)
    b = (b.config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          .config("spark.sql.session.timeZone", "UTC")
          .config("spark.ui.enabled", "false")
          # checkpoint files go when nothing refers to them any more
          .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    The cluster's ``spark.checkpoint.dir`` wins.  Where it is unset a private
    scratch folder is made on a local master (as in tests); on a cluster the
    executors could not see it, so that is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="tavola-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder.

    Used between iterations of multi-pass jobs so that a lost executor only
    recomputes from the last written checkpoint.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def reuse(df: DataFrame) -> DataFrame:
    """Mark a DataFrame that later steps reference several times: it is
    computed once and kept on the executors' local disks (not in the heap,
    so joins, sorts and aggregations keep their execution memory).  A lost
    executor only costs recomputing its partitions from lineage."""
    from pyspark import StorageLevel
    return df.persist(StorageLevel.DISK_ONLY)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written tables."""
    return checkpoint_dir(spark).rstrip("/") + "/" + name
