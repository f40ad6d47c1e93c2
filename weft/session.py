"""Session helpers: a sensible local session and the durable folder for landed data."""
from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "weft") -> SparkSession:
    """Session for tests and the bench. On a cluster, build your own session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        # paid calls must not be repeated by speculative copies of a task
        .config("spark.speculation", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for landed state and reliable checkpoints.

    Uses ``spark.checkpoint.dir`` (or a directory already set on the context).
    Only a local-mode session without one gets a fresh folder under the
    system temp directory, as tests do; a cluster session must name one.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir() or conf
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before landing data on a cluster")
    path = tempfile.mkdtemp(prefix="weft-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def state_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the checkpoint directory for a named landed table."""
    base = checkpoint_dir(spark)
    return os.path.join(base, "weft-state", name) if "://" not in base else f"{base.rstrip('/')}/weft-state/{name}"


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable by executor Python workers (once per application).

    Zips the package next to the driver and registers it with ``addPyFile``;
    Spark copies it to every executor and puts it on the workers' path.
    """
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out = os.path.join(tempfile.mkdtemp(prefix="weft-pkg-"), "weft.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(app)
