"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
}


def build_session(master: str | None = None, app: str = "seqweft", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package to the executors, unless they are threads of this process that find it where it does.

    Functions that run in Python workers are sent by name, so the workers must be able to import them.
    """
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    found = home in map(os.path.abspath, [os.getcwd(), *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))])
    context = spark.sparkContext
    if (found and one_process(context.master)) or getattr(context, "_seqweft_shipped", False):
        return spark
    folder = tempfile.mkdtemp(prefix="seqweft-package-")
    path = os.path.join(folder, "seqweft-package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for at, _, files in os.walk(os.path.join(home, "seqweft")):
            for name in files:
                if name.endswith(".py"):
                    out.write(os.path.join(at, name), os.path.relpath(os.path.join(at, name), home))
    context.addPyFile(path)
    context._seqweft_shipped = True
    return spark


def one_process(master: str) -> bool:
    return re.fullmatch(r"local(\[[^\]]*\])?", master) is not None


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in spark.checkpoint.dir.

    Only a session inside one process, without that setting, gets a temporary folder of its own, which goes
    with the process.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not one_process(spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="seqweft-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own for every run, so that no run overwrites another's tables."""
    return f"{shared_folder(spark).rstrip('/')}/{run_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def run_folder(spark: SparkSession) -> str:
    """One folder for all that an application stores, so that it can be removed as a whole."""
    return f"seqweft-{spark.sparkContext.applicationId}"


def remove_scratch(spark: SparkSession) -> None:
    """Removes what this application has stored; tables that still read it must be written elsewhere before."""
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(f"{shared_folder(spark).rstrip('/')}/{run_folder(spark)}")
    if where.get_file_info(path).type != fs.FileType.NotFound:
        where.delete_dir(path)
