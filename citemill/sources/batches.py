"""Arrow batches of a bounded size, for all that crosses to Python."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

ROWS = 1000
BYTES = 4 * 1024 * 1024


def bounded(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches hold so many rows and bytes at most: a run of long texts can't fill a worker. Plans read
    these settings when they run, so they stay for the session; a tighter bound of the caller stays."""
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", ROWS), ("maxBytesPerBatch", BYTES)):
        now = re.fullmatch("([0-9]+)b?", conf.get(f"spark.sql.execution.arrow.{name}"))
        if not now or not 0 < int(now[1]) <= most:
            conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    return df
