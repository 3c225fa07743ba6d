"""Session settings that suit these jobs; a cluster's own settings win over all of them."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings for reports of any size. Adaptive execution sizes shuffle partitions, splits skewed join partitions and picks
# broadcast joins from measured sizes, so no partition count is baked into a report.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join even where the aggregate above could have used its partitioning.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A top-k holds its rows in memory per task; a question may ask for any number of them.
    "spark.sql.execution.topKSortFallbackThreshold": "100000",
}


def local_session(app: str, cores: int | str = "*", **settings: str) -> SparkSession:
    """A ``local[cores]`` session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tune(spark: SparkSession) -> SparkSession:
    """Applies the settings above to a session, except those its cluster chose at start."""
    chosen = spark.sparkContext.getConf()
    for key, value in SETTINGS.items():
        if not chosen.contains(key):
            spark.conf.set(key, value)
    return spark
