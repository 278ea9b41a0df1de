"""Session defaults and the shared scratch location.

Everything that writes intermediate data (sinks, lineage cuts) goes under the
folder the cluster names in ``spark.checkpoint.dir``. A private folder is only
created when that setting is absent on a local master, as in tests; on a
cluster its absence is an error, since executors don't share local folders.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "notewise",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the settings this library assumes.

    AQE is on so that shuffle partition counts coalesce at runtime and small
    join sides found at runtime become broadcast joins; skew-join splitting is
    on for hot subject keys. ``shuffle_partitions`` is the pre-AQE upper bound:
    size it to the cluster (about 2-3x total cores, or data/128 MB).
    """
    cpus = os.cpu_count() or 8
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64m",
        "spark.sql.shuffle.partitions": str(shuffle_partitions or 2 * cpus),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.driver.memory": os.environ.get("NOTEWISE_DRIVER_MEMORY", "16g"),
    }
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a private one only if unset."""
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the server's spark.checkpoint.dir applies
        return spark.conf.get("spark.checkpoint.dir", "")
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="notewise-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers (once per application), for kernels that
    they unpickle by name; needless where it is installed on every node."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="notewise-zip-"), "notewise.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("notewise", os.path.relpath(full, here)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for a written table."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/notewise-{name}-{uuid.uuid4().hex[:12]}"


def materialize(df):
    """Cut lineage: write ``df`` to the shared checkpoint folder (reliable
    checkpoint, eager) and return a DataFrame over the written copy.

    Used for small intermediate tables that several later steps read (per
    subject flags, distinct scores, minority vectors), so the expensive scan
    behind them runs once, and a lost executor re-reads the checkpoint
    instead of recomputing the scan.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


BROADCAST_MAX_ROWS = 1_000_000


def broadcast_if_small(df, max_rows: int = BROADCAST_MAX_ROWS):
    """Checked broadcast for small tables whose size depends on the data
    (one row per stratum, per group, per group x bucket).

    The table is checkpointed (so it is computed once), its rows are
    counted, and it is broadcast only under ``max_rows``; beyond that the
    join is left to the planner (sort-merge join, AQE). Tables bounded by a
    constant (a fixed number of buckets or bins) are hinted directly."""
    from pyspark.sql import functions as F
    df = materialize(df)
    return F.broadcast(df) if df.count() <= max_rows else df
