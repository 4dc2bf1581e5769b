"""Sessions for tests, the bench and notebooks; a cluster brings its own."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(
    app: str, cores: int | str = "*", memory: str = "12g", checkpoint_dir: str | None = None
) -> SparkSession:
    """``checkpoint_dir`` is where tables are kept that are read several times."""
    folder = checkpoint_dir or tempfile.mkdtemp(prefix="newsloom-")
    partitions = cores if isinstance(cores, int) else 8
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.checkpoint.dir", folder)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
