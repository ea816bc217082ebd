"""Session settings that suit the library; every function also works on a session made elsewhere."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


#: What streams with states of their own need.
STREAMING = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def build(master: str = "local[*]", app: str = "ledgerloom", **more: str) -> SparkSession:
    """A session with DEFAULTS, overridden by more."""
    return SparkSession.builder.master(master).appName(app).config(map=DEFAULTS | more).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    """The Parquet table name below sf_dir."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_UNSET: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder in spark.checkpoint.dir, which driver and executors share; where that is unset, below a folder
    of this machine if they are one process, as in tests, and else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        root = _UNSET[app] = _UNSET.get(app) or "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
    return f"{root.rstrip('/')}/ledgerloom/{name}-{uuid.uuid4().hex[:12]}"


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once an application, so that it need not be installed there."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    here = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="ledgerloom-")) / f"{here.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f"{here.name}/{f.relative_to(here)}")
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)
