"""What the operators share: reading tables, shared scratch tables, and Python workers that can import this package."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workers_import(spark: SparkSession) -> None:
    """Puts the package's root on the path of Python workers, for sessions that were started from elsewhere."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, as in tests on one machine, a temporary folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = _own.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="timelineql-")
        _own[spark.sparkContext.applicationId] = found
    return found


def fresh(taken, *names: str) -> list[str]:
    """These names, each with as many underscores before it as it takes not to be among taken, in any case of letters."""
    have, out = {c.lower() for c in taken}, []
    for n in names:
        while n.lower() in have:
            n = "_" + n
        have.add(n.lower())
        out.append(n)
    return out


class Scratch:
    """Tables written once to the shared folder and read again: they cut lineage, and outlive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.home = f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"
        workers_import(spark)
        atexit.register(self.drop)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.home}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.home}/{name}")

    def drop(self, *names: str) -> None:
        """Removes these tables, or all; what is still to be computed must not read them."""
        sc = self.spark.sparkContext
        if sc._jsc is None or sc._gateway is None:
            return
        try:
            for p in [f"{self.home}/{n}" for n in names] or [self.home]:
                path = sc._jvm.org.apache.hadoop.fs.Path(p)
                path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session has ended; its own cleaning is all that is left
            if names:
                raise
