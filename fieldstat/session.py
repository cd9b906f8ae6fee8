"""Session helpers."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package's sources to the executors' Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        here = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="fieldstat-src-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = os.path.join(folder, "fieldstat_src.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for top, _, names in os.walk(here):
                for n in names:
                    if n.endswith(".py"):
                        full = os.path.join(top, n)
                        z.write(full, os.path.relpath(full, os.path.dirname(here)))
        spark.sparkContext.addPyFile(path)
        _SHIPPED.add(app)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir as a URI; where that is unset, a temporary one, in local mode alone."""
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="fieldstat-")
        spark.sparkContext.setCheckpointDir(folder)
    return re.sub(r"^file:/+", "file:///", spark.sparkContext.getCheckpointDir())


def kept(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in :func:`shared_folder`."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
