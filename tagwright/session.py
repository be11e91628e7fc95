"""Session helpers: building a local session for tests and benches, and the
shared scratch folder used to cut lineage or round-trip files.

On a cluster the folder comes from ``spark.checkpoint.dir`` (a shared file
system path named by the cluster configuration). Only when that setting is
absent -- local tests -- do we fall back to a fresh temporary folder.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "tagwright") -> SparkSession:
    """A local session with the settings we would also use on a cluster
    (AQE on, UI off, Arrow on). Tests and bench use this."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        # the test files are one row group each, which no scan can split
        .config("tagwright.spreadSingleSplit", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a local one only if the
    session has none (as in tests)."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: only the SQL conf is visible
        sc = None
    path = sc.getCheckpointDir() if sc is not None else None
    if path:
        return path
    conf = sc.getConf().get(CHECKPOINT_CONF, None) if sc is not None else None
    if not conf:
        try:
            conf = spark.conf.get(CHECKPOINT_CONF)
        except Exception:  # noqa: BLE001 - unset
            conf = None
    if not conf:
        master = sc.master if sc is not None else ""
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="tagwright-ckpt-")
        atexit.register(shutil.rmtree, conf, ignore_errors=True)
    if sc is not None:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir() or conf
    return conf


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "tagwright", f"{name}-{uuid.uuid4().hex[:12]}")


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts lineage so a lost executor re-reads the table instead of recomputing
    the whole plan; unlike a local checkpoint, the data survives the loss.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def cluster_conf(total_cores: int) -> dict[str, str]:
    """Settings for a large cluster (pass to ``SparkSession.builder.config``).

    Input splits of 256 MB keep a task's texts in memory while regexes run;
    many shuffle partitions with AQE coalescing adapt to the real data size;
    AQE's skew join splits hot keys; Arrow batches are kept small because a
    row may hold a whole article."""
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
        "spark.sql.files.maxPartitionBytes": "256m",
        "spark.sql.shuffle.partitions": str(max(200, 4 * total_cores)),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    }
