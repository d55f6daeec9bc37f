"""Session helpers: local sessions for tests and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, app: str = "barlattice", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset
    (local tests) a folder of our own is chosen.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="barlattice-checkpoint-")
        atexit.register(shutil.rmtree, named, True)
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _remove(context, folder: str) -> None:
    try:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the JVM may be gone; the folder is the cluster's to clear
        pass


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints for a table that several steps read; removed when the driver ends."""
    folder = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark.sparkContext, folder)
    return folder


def prepare(spark: SparkSession) -> SparkSession:
    """Makes the package importable for Python workers; call it once before using the operators.

    Workers on this machine get its folder in their path; executors elsewhere get
    the package as a zip file from the driver.
    """
    context = spark.sparkContext
    root = str(Path(__file__).resolve().parents[1])
    paths = [p for p in context.environment.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        context.environment["PYTHONPATH"] = ":".join([root, *paths])
        if not context.master.startswith("local"):
            target = Path(tempfile.mkdtemp(prefix="barlattice-package-")) / "barlattice.zip"
            with zipfile.ZipFile(target, "w") as z:
                for f in sorted(Path(root, "barlattice").rglob("*.py")):
                    z.write(f, f.relative_to(root))
            context.addPyFile(str(target))
    return spark
