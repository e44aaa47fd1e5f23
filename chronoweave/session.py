"""A session with the settings that the library's results rest on."""

from pyspark.sql import SparkSession


def session(master: str = "local[*]", *, shuffle_partitions: int = 8, memory: str = "8g", **more: str) -> SparkSession:
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    return SparkSession.builder.master(master).config(map=conf | more).getOrCreate()
