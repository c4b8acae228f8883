"""Session settings and lineage cuts.

The library never creates a session behind the caller's back; :func:`local_session`
is for tests, the bench and the driver contract.  On a cluster the operator builds
the session and the jobs only read its settings.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on.  AQE re-plans joins with runtime sizes (a sort-merge
# join whose build side turns out small becomes a broadcast join), coalesces small
# shuffle partitions and splits skewed join partitions, which covers the case of one
# product, zone or employee holding a third of all rows.
SESSION_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}


def local_session(
    cpus: int | str = "*",
    shuffle_partitions: int = 8,
    app: str = "stockroom",
    extra_conf: dict | None = None,
    master: str | None = None,
) -> SparkSession:
    """A local session for tests and the bench (UI off, UTC, AQE on); ``extra_conf`` is applied last.

    ``master`` overrides ``local[cpus]``, e.g. ``local-cluster[2,2,2048]`` for separate
    executor processes.
    """
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
    )
    for key, value in {**SESSION_DEFAULTS, **(extra_conf or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def recommended_settings(largest_input_bytes: int, total_cores: int, target_partition_bytes: int = 256 << 20) -> dict:
    """Partition sizing for a cluster: shuffle partitions and input splits that fit in memory.

    Initial shuffle partitions are sized so the largest table splits into pieces of
    about ``target_partition_bytes`` (and at least three waves of tasks over all
    cores); AQE then coalesces small ones down to the advisory size.
    """
    by_size = -(-largest_input_bytes // target_partition_bytes)
    partitions = max(3 * total_cores, by_size)
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes // 2),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes // 2),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(target_partition_bytes),
    }


def apply_defaults(spark: SparkSession) -> SparkSession:
    """Apply :data:`SESSION_DEFAULTS` to an existing session (runtime SQL confs only)."""
    for key, value in SESSION_DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, setting one only for local runs.

    A cluster names a shared folder in ``spark.checkpoint.dir``; it is read from the
    session and used as is.  Only a local master without one gets a fresh scratch
    folder, because a machine-local folder is useless once executors are remote.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running stockroom jobs")
    path = tempfile.mkdtemp(prefix="stockroom-ckpt-")
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` into the shared checkpoint folder and cut its lineage.

    Used where a frame is read by two later passes that must see identical rows
    (for example a computed row index); a lost executor then re-reads the
    checkpoint instead of recomputing a different answer.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
