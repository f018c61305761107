"""Change bursts: events of one key whose gaps stay within a limit form one batch."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bursts(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """user_id, started, n; works on a stream with a watermark on ``ts`` as on a table."""
    w = F.session_window("ts", gap)
    return events.groupBy("user_id", w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("started"), "n")
