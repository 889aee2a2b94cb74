"""Session helpers: a local session for tests/bench and the checkpoint folder rule."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "vitaplate") -> SparkSession:
    """A local session configured the way tests and bench run (UI off, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("VITAPLATE_DRIVER_MEMORY", "16g"))
        .config("spark.sql.session.timeZone", "UTC")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


_LOCAL_DIRS: dict[int, str] = {}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder for checkpoints and materialised tables.

    The cluster names it in ``spark.checkpoint.dir`` (or the context already has
    one); that is always used.  Only a local-mode session with nothing configured
    (tests, a bare local session) gets a scratch folder of our own, once per
    session; on a cluster a missing setting is an error.
    """
    configured = None
    try:
        configured = spark.conf.get("spark.checkpoint.dir", None)
    except Exception:  # noqa: BLE001 - some session kinds refuse unknown keys
        configured = None
    sc = None
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - e.g. a Connect session has no SparkContext
        sc = None
    if not configured and sc is not None:
        configured = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        master = ""
        try:
            master = spark.conf.get("spark.master", "") or (sc.master if sc is not None else "")
        except Exception:  # noqa: BLE001
            master = sc.master if sc is not None else ""
        # "local" and "local[...]" run in one process; "local-cluster[...]" and unknown masters do not
        if not (master == "local" or master.startswith("local[")):
            # A machine-local folder would vanish with its executor: the cluster must name a shared one.
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on HDFS or an object store)")
        key = id(spark)
        if key not in _LOCAL_DIRS:
            _LOCAL_DIRS[key] = tempfile.mkdtemp(prefix="vitaplate-ckpt-")
        configured = _LOCAL_DIRS[key]
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(configured)
    return configured
