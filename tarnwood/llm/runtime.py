"""Session helpers shared by the operators: scratch tables and worker set-up."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in parts:
        env["PYTHONPATH"] = os.pathsep.join([root, *parts])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    Only where it is unset and the session is a local one (as in tests) is a
    temporary folder made; on a cluster a missing setting is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if sc.getCheckpointDir():
        return sc.getCheckpointDir().rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = own = tempfile.mkdtemp(prefix="tarnwood-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return _OWN[sc.applicationId]


class Scratch:
    """Tables written to the shared folder, which cut the lineage of a plan.

    ``keep`` writes a frame and returns it as read back, so that a lost
    executor costs only the tasks it ran; ``drop`` removes what no later step
    reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.paths = spark, f"{shared_dir(spark)}/tarnwood/{name}-{uuid.uuid4().hex[:12]}", {}
        self.made = 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            at = jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(t)))
            at.getFileSystem(conf).delete(at, True)
