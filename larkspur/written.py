"""Tables written to the folder that the driver and all executors share: lineage ends there, and a lost executor costs nothing."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; one of our own only on a local master (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return (folder or f"file:///tmp/larkspur-{os.getuid()}/streams").rstrip("/")


_own: set[str] = set()


def own_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's part of the shared folder, which goes when the application ends (where the folder is mounted here)."""
    own = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"
    if own not in _own and urlparse(own).scheme in ("", "file"):
        _own.add(own)
        atexit.register(shutil.rmtree, unquote(urlparse(own).path), ignore_errors=True)
    return f"{own}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table: what is made of it several times is made once, and its lineage ends there."""
    path = own_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
