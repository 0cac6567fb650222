"""Session, table reading and materialisation helpers shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Give the package to the executors, once an application: their Python may start without its path."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        _SHIPPED.add(app)
        here = Path(__file__).resolve().parent
        tmp = tempfile.mkdtemp(prefix="folioforge-code-")  # Spark's file server reads it as long as the driver lives
        atexit.register(shutil.rmtree, tmp, ignore_errors=True)
        path = f"{tmp}/folioforge_{app.replace('-', '_')}.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(here.rglob("*.py")):
                z.write(f, f.relative_to(here.parent))
        spark.sparkContext.addPyFile(path)
    return spark


def local_session(cores: int = 8, shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    return ship(
        SparkSession.builder.master(f"local[{cores}]")
        .appName("folioforge")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` where the cluster names one; a local folder only for
    sessions that leave it unset (tests on one machine)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="folioforge-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _OWN[app] = "file://" + own
    return _OWN[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already; the driver's JVM deletes the folder when it ends
        pass


def _write(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/folioforge/{uuid.uuid4().hex}"
    df.write.parquet(path)
    # The file system forgets what it deleted before; what is left goes when the driver's JVM ends, session or not.
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path), path


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, survives lost executors, and keeps
    column pruning. For results that are read after the operator returns; deleted when the driver's JVM ends."""
    return _write(df)[0]


class Scratch:
    """Stages of one operator, deleted when it ends: ``with Scratch() as tmp: a = tmp(df)``. What the operator returns must
    not read them; its last step is written with ``stage``."""

    def __init__(self) -> None:
        self._held: list[tuple[DataFrame, str]] = []

    def __enter__(self) -> Scratch:
        return self

    def __call__(self, df: DataFrame) -> DataFrame:
        out, path = _write(df)
        self._held.append((out, path))
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a stage before the end."""
        for held in [h for h in self._held if h[0] is df]:
            _remove(held[0].sparkSession, held[1])
            self._held.remove(held)

    def __exit__(self, *_: object) -> None:
        for df, path in self._held:
            _remove(df.sparkSession, path)
        self._held.clear()
