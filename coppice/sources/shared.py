"""Results that are computed once: written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile


def shared_dir(spark) -> str:
    """Reads spark.checkpoint.dir from the session. Where none is set, a local master gets a temporary folder; a cluster has none that its machines share, so that is an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not named:
            named = tempfile.mkdtemp(prefix="coppice-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def settled(df):
    """The rows of df, written to the shared checkpoint folder: lineage ends here."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def delete(spark, path: str) -> None:
    """Removes a folder in whatever store it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
