"""Session factory with the settings that every module of the package relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def master_given() -> bool:
    """Whether this process was started by ``spark-submit``, or is to pass it a master."""
    return "PYSPARK_GATEWAY_PORT" in os.environ or "--master" in os.environ.get("PYSPARK_SUBMIT_ARGS", "")


def build_session(app: str = "lodestrata", cores: int | str = "*", shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session (UTC, AQE, skew handling). The master is the one that ``spark-submit`` or LODESTRATA_MASTER names; local without one.

    ``shuffle_partitions`` should follow the input: about one for each 128 MB that the largest shuffle moves. AQE
    puts small partitions together and splits skewed joins, but can't split what a setting of 200 makes of 100 TB.
    """
    builder = SparkSession.builder.appName(app)
    if not master_given():
        builder = builder.master(os.environ.get("LODESTRATA_MASTER", f"local[{cores}]"))
    builder = (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
