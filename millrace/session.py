"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def local_session(cpus: int = 8, shuffle_partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A session on this machine for tests and benches."""
    s = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder all machines share (spark.checkpoint.dir); on one machine in a folder of its own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        named = "file://" + tempfile.mkdtemp(prefix="millrace-files-")
    return f"{named.rstrip('/')}/millrace/{name}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each context; they need not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_millrace_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="millrace-ship-"), "millrace_package.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(top):
            for n in sorted(names):
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.join("millrace", os.path.relpath(path, top)))
    sc.addPyFile(out)
    sc._millrace_shipped = True
