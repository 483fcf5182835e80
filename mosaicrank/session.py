"""Session helpers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the Python workers of this application the package, once."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    home = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="ship-")) / f"{home.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, f"{home.name}/{p.relative_to(home)}")
    sc.addPyFile(str(path))
    _SHIPPED.add(sc.applicationId)


def local_session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
