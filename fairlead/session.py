"""Sessions for vessel-traffic jobs: UTC, adaptive execution, RocksDB state."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "fairlead", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's settings; ``conf`` wins over them. ``master`` is left to spark-submit if None."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, which a cluster must name. A local session without it uses
    its warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and (spark.sparkContext.master + "[").startswith("local["):
        base = spark.conf.get("spark.sql.warehouse.dir")
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/fairlead"
