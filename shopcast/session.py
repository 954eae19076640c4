"""Session helpers.

Library code never creates its own cluster settings; it reads what the session
already has.  ``get_session`` is for tests, scripts and the bench only.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "shopcast") -> SparkSession:
    """Create or reuse a session with the settings the library assumes."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.appName(app_name).master(master or f"local[{cpus}]")
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
    builder = builder.config("spark.driver.memory", os.environ.get("SHOPCAST_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def one_machine(master: str) -> bool:
    """Whether driver and executors are one process (``local-cluster`` has executors of its own)."""
    return master == "local" or master.startswith("local[")


def offer_checkpoint_dir(spark: SparkSession) -> None:
    """Set the checkpoint folder where one is known; queries that write nothing need none."""
    if spark.conf.get("spark.checkpoint.dir", None) or one_machine(spark.sparkContext.master):
        ensure_checkpoint_dir(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder of the session.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is.  Only when nothing is configured (local tests) a scratch folder is set.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not one_machine(sc.master):
            raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a shared "
                               "folder (checkpoints and written tables go there)")
        conf_dir = tempfile.mkdtemp(prefix="shopcast-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's checkpoint location for written tables."""
    base = ensure_checkpoint_dir(spark)
    import uuid
    return f"{base.rstrip('/')}/shopcast-{name}-{uuid.uuid4().hex[:12]}"
