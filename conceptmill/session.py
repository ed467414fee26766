"""A session for local use; on a cluster the caller brings its own."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("conceptmill")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application."""
    import atexit
    import shutil
    import tempfile
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, "_conceptmill_sent", False):
        return
    here = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="conceptmill-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    made = shutil.make_archive(str(Path(folder) / "conceptmill"), "zip", here.parent, here.name)
    sc.addPyFile(made)  # the driver serves the file
    sc._conceptmill_sent = True
