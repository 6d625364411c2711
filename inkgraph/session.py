"""Session building, code shipping and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent


def build_session(app: str = "inkgraph", cores: str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own settings."""
    path = os.environ.get("PYTHONPATH", "")
    if str(ROOT) not in path.split(os.pathsep):
        os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (str(ROOT), path) if x)
    base = {
        "spark.master": f"local[{cores}]",
        "spark.driver.memory": "8g",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.host": "127.0.0.1",
    }
    builder = SparkSession.builder.appName(app)
    for k, v in {**base, **conf}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, whatever their working directory is."""
    sc = spark.sparkContext
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_inkgraph_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="inkgraph-")) / "inkgraph_src.zip"  # read by the driver's file server only
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((ROOT / "inkgraph").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(target))
    sc._inkgraph_shipped = True


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that the cluster shares.

    ``spark.checkpoint.dir`` is read from the session; a folder of our own is only set where it is unset
    (local mode), never on a cluster that names one.
    """
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, set where it is not; off local mode a session must name one that all machines share."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="inkgraph-ckpt-"))
    return sc._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, over: DataFrame | None = None) -> DataFrame:
    """Cut the lineage, and with it the size estimates, by a table written to the shared checkpoint folder.

    A checkpoint hands on the plan's estimated size; in a loop of joins those estimates multiply round by round until
    the numbers themselves fill the driver.  A table read back has the size that it has.  ``over``: a table of an earlier
    round that nothing needs any more; its files go.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (old := getattr(over, "_written", None)) is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(old)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    out = spark.read.parquet(path)
    out._written = path
    return out
