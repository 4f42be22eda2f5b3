"""Spark sessions with the settings that the operators assume."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(app: str = "girder", **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``settings`` with ``_`` for ``.`` come on top. Workers get this package."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in settings.items():
        builder = builder.config(key.replace("_", "."), value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


#: Applications whose workers have this package.
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, which need it where functions run in Python, once for each application.

    Local workers that find it by themselves, in their folder or by PYTHONPATH, are left alone.
    """
    context, root = spark.sparkContext, Path(__file__).resolve().parent
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    found = {Path(p).resolve() for p in [os.getcwd(), *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]}
    if not context.master.startswith("local") or root.parent not in found:
        context.addPyFile(shutil.make_archive(str(Path(tempfile.mkdtemp()) / root.name), "zip", root.parent, root.name))


def table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
