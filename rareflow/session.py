"""Session construction and the shared working folder.

On a cluster the working folder is the one named by ``spark.checkpoint.dir``
(a shared file system); it is only created here when the session has none,
which is the case in local tests.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str = "local[*]", app: str = "rareflow",
                  shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; create a local one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="rareflow-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/rareflow-work/{name}-{uuid.uuid4().hex[:12]}"


MB = 1 << 20


def cluster_conf(input_bytes: int, cores: int, checkpoint_dir: str) -> dict[str, str]:
    """Settings for a cluster run, sized from the input and the number of executor cores.

    - scan splits of 512 MB: 100 TB gives ~200k scan tasks, ~25 waves on 8000 cores;
    - initial shuffle partitions at ~256 MB of input each, which AQE coalesces toward 256 MB per
      partition after partial aggregation has shrunk the data; at most 200,000, since the driver keeps
      a status for every pair of map task and partition (beyond ~50 TB partitions grow, results don't change);
    - skew-join splitting above 5x the median partition and 512 MB;
    - writes capped per file so output files stay splittable;
    - the shared checkpoint folder that the sweeps and streams write to.
    """
    if cores <= 0 or input_bytes < 0:
        raise ValueError("cores must be positive and input size non-negative")
    shuffle = int(min(200_000, max(2 * cores, input_bytes // (256 * MB))))
    return {
        "spark.sql.files.maxPartitionBytes": str(512 * MB),
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * MB),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 * MB),
        "spark.sql.files.maxRecordsPerFile": str(20_000_000),
        "spark.sql.session.timeZone": "UTC",
        "spark.checkpoint.dir": checkpoint_dir,
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
    }
