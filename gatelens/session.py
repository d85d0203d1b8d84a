"""Session helpers: a tuned local session for tests/bench and lineage cutting.

Nothing here overrides settings a cluster already provides: the checkpoint
folder is read from ``spark.checkpoint.dir`` and only filled in when unset
(tests, local runs).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # broadcast only what is small by construction; AQE may still switch at runtime
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "gatelens") -> SparkSession:
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config(SPREAD_CONF, str(2 * (os.cpu_count() or 1 if str(cpus) == "*" else int(cpus))))
    b = b.config("spark.driver.memory", os.environ.get("GATELENS_DRIVER_MEM", "16g"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder, read from ``spark.checkpoint.dir``.

    Only a local master, where driver and executors are one machine, gets a scratch folder when none is configured;
    elsewhere a folder of this machine would not be seen by the executors, so that is an error.
    """
    cur = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Connect: the server owns the checkpoint folder
        sc = None
    if not cur and sc is not None:
        cur = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if not cur:
        master = sc.master if sc is not None else "connect"
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors share (master {master})")
        cur = tempfile.mkdtemp(prefix="gatelens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", cur)
    if sc is not None:
        sc.setCheckpointDir(cur)
    return cur


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


SPREAD_CONF = "spark.gatelens.spreadPartitions"


def spread(df: DataFrame) -> DataFrame:
    """Round-robin ``df`` to the number of partitions given in ``spark.gatelens.spreadPartitions``, if it is set.

    A setting for small tables whose few files would leave most cores idle in CPU-heavy row work (local runs set it);
    clusters leave it unset, and nothing is shuffled.
    """
    n = df.sparkSession.conf.get(SPREAD_CONF, None)
    return df.repartition(int(n)) if n else df
