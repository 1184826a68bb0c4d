"""Session helpers that every operator with Python workers uses."""

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
    """Let Python workers import this package from where the driver has it; no setting of the session is changed."""
    root = str(Path(__file__).resolve().parents[1])
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
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = own = tempfile.mkdtemp(prefix="tarnwood-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return _OWN[sc.applicationId]


def keep(df: DataFrame, name: str) -> DataFrame:
    """The frame written as Parquet to the shared folder and read back: a plan that reads it twice computes it once, and a lost executor costs only its own tasks."""
    path = f"{shared_dir(df.sparkSession)}/tarnwood/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
