"""Named queries that run a stream to its end, with SQL on the table that it reads."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quern.operators.graph import scratch
from quern.plans.catalogue import query
from quern.sources import tables as T
from quern.streaming import told as W

#: How long a user's event of one kind stays untold after it was told (fixed).
QUIET_HOURS = 24


@query(f"""WITH RECURSIVE e AS (SELECT concat_ws(':', user_id, event_type) AS fingerprint, ts FROM events WHERE ts IS NOT NULL),
told AS (SELECT fingerprint, min(ts) AS ts FROM e GROUP BY fingerprint UNION ALL SELECT t.fingerprint, min(e.ts) FROM told t JOIN e ON e.fingerprint = t.fingerprint AND e.ts >= t.ts + INTERVAL {QUIET_HOURS} HOUR GROUP BY t.fingerprint)
SELECT fingerprint, ts FROM told""")
def events_told(spark, d):
    # the stream's files come in any order: the watermark waits for as long as the table spans
    ts = T.table(spark, d, "events").agg(F.min("ts").cast("timestamp").alias("a"), F.max("ts").cast("timestamp").alias("z")).first()
    span = int((ts.z - ts.a).total_seconds()) + 1 if ts.a else 0
    rows = T.stream(spark, d, "events").select(F.concat_ws(":", "user_id", "event_type").alias("fingerprint"), F.col("ts").cast("timestamp").alias("ts"))
    at = f"{scratch(spark)}/told-{uuid.uuid4().hex}"
    W.run_to_end(W.told(rows, QUIET_HOURS * 3600, f"{span} seconds"), f"{at}/out", f"{at}/state")
    return spark.read.schema("fingerprint string, ts timestamp").parquet(f"{at}/out").select("fingerprint", F.col("ts").cast("timestamp_ntz").alias("ts"))
