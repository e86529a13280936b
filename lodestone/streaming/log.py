"""The query log as a stream: append, rate limits, and the cache's replay."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.usage import log_rows
from ..sources import log as log_table


def append_log(results: DataFrame, folder: str, checkpoint: str, **privacy) -> StreamingQuery:
    """Results into the log table, exactly once a batch."""
    return log_rows(results, **privacy).writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_once(results: DataFrame, folder: str, checkpoint: str, writer: str, **privacy) -> StreamingQuery:
    """Results into the log table of ``sources.log``, as batches of this writer.

    A micro-batch that is run again after a failure has its old number, which
    the table's record knows, so its rows are there once and keep their ids.
    """

    def add(batch: DataFrame, number: int) -> None:
        log_table.append(log_rows(batch, **privacy), folder, writer, number)

    return results.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def over_limit(requests: DataFrame, client: str, at: str, per_minute: int = 10, late: str = "2 minutes") -> DataFrame:
    """Clients over their limit, a row a client and minute once it is closed."""
    counted = requests.withWatermark(at, late).groupBy(F.window(at, "1 minute"), client).agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") > per_minute).select(client, F.col("window.start").alias("minute"), "n")


def ttl_hits(requests: DataFrame, ttl: float) -> DataFrame:
    """(key, at, seq, hit) of a cache with a fixed life from its write.

    State is one expiry a key. Requests of a micro-batch are taken in order.
    """

    def work(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        until = state.get[0] if state.exists else float("-inf")
        own = pd.concat(list(batches)).sort_values(["at", "seq"])
        hits = []
        for at in own["at"]:
            hits.append(at < until)
            if not hits[-1]:
                until = at + ttl
        state.update((until,))
        yield pd.DataFrame({"key": key[0], "at": own["at"], "seq": own["seq"], "hit": hits})

    return requests.groupBy("key").applyInPandasWithState(work, "key string, at double, seq long, hit boolean", "until double", "append", GroupStateTimeout.NoTimeout)
