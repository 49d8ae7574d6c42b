"""Session helpers: a factory, shared intermediate tables, shipping of the package to executors."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_folders: dict[str, str] = {}


def build_session(app: str = "plumbline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine is tuned for; ``conf`` overrides (dots as double underscores)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in base.items():
        b = b.config(k, v)
    return b.getOrCreate()


#: Bytes of an Arrow batch on its way to or from a Python worker, at most (a row above it comes alone).
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application, and bound their batches in bytes.

    Spark bounds batches by 10,000 rows and 64 MB; every running task holds one on each side of the pipe. A smaller
    bound that the session sets itself, in plain bytes, is kept.
    """
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(limit)).rstrip("bB")
    if not now.lstrip("-").isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(limit, BATCH_BYTES)
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    # the driver serves this file to the executors for as long as the application runs
    target = os.path.join(tempfile.mkdtemp(prefix="plumbline-pkg-"), "plumbline_pkg.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: under spark.checkpoint.dir where the cluster names one.

    Only where that setting is unset and everything runs in one process (tests, a laptop) a folder of its own is used;
    on a cluster without the setting this raises, since a local folder would not be shared.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _folders:
        base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
        if not base:
            if not re.match(r"local(\[|$)", sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="plumbline-")
            sc.setCheckpointDir(base)
        folder = f"{base.rstrip('/')}/plumbline-{sc.applicationId}-{uuid.uuid4().hex[:8]}"
        _folders[sc.applicationId] = folder
        atexit.register(_remove, sc, folder)
    return _folders[sc.applicationId]


def _remove(sc, folder: str) -> None:
    try:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the JVM may be gone already
        pass


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:8]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_materialised(df: DataFrame) -> None:
    """Delete a table written by :func:`materialise` once nothing reads it any more."""
    sc = df.sparkSession.sparkContext
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        if f"/plumbline-{sc.applicationId}-" in f:
            _remove(sc, f)
