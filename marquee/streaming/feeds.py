"""Streams: new events that need an action, request windows, and a cache's live entries.

Lateness is an addition of this library: by default an hour.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState


def needing_action(events: DataFrame, flag: str = "thumbnailGenerated") -> DataFrame:
    """Events with an image and without the flag."""
    return events.filter((F.coalesce("imageUrl", F.lit("")) != "") & ~F.coalesce(F.col(flag), F.lit(False)))


def recent(events: DataFrame, as_of: str, minutes: int = 5) -> DataFrame:
    """The catch-up query: events scraped in the last minutes."""
    return events.filter(F.col("scrapedAt") >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(minutes)} MINUTES"))


def once_each(events: DataFrame, id_column: str = "event_id", time: str = "scrapedAt", late: str = "1 hour") -> DataFrame:
    """Each event once within the lateness; state older than that is dropped."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([id_column])


def run_actions(events: DataFrame, action: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand each batch of new events to ``action``, until what is there is done."""
    return events.writeStream.foreachBatch(action).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def request_windows(log: DataFrame, window: str = "1 hour", slide: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Requests and successes per domain in sliding windows over ``ts``."""
    per = log.withWatermark("ts", late).groupBy(F.window("ts", window, slide).alias("w"), "domain")
    return per.agg(F.count("*").alias("requests"), F.sum("success").alias("successes")).select("w.start", "w.end", "domain", "requests", "successes")


READS = "url string, at timestamp, hit boolean, data string, hits long"


def cached_reads(log: DataFrame, ttl_ms: int, late: str = "1 hour") -> DataFrame:
    """Reads of a cache from a stream of reads and writes: url, at, hit, data (null for a miss) and hits of the entry with this read.

    log: url, kind (``get`` or ``set``), data, at. A write starts an entry anew;
    a read of one older than the time to live deletes it and misses. State is
    one entry a URL, and goes when the watermark has passed its time to live
    (and ``late``), so it is bounded by the URLs of that time. Within a trigger
    a URL's rows are taken in the order of ``at``, writes before reads.
    """
    import pandas as pd

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["at", "kind"], ascending=[True, False], kind="stable")
        entry = state.get if state.exists else None
        out = []
        for kind, data, at in zip(rows["kind"], rows["data"], rows["at"], strict=True):
            ms = int(at.timestamp() * 1000)
            if kind == "set":
                entry = (data, ms, 0)
                continue
            if entry is not None and ms - entry[1] > ttl_ms:
                entry = None
            if entry is not None:
                entry = (entry[0], entry[1], entry[2] + 1)
            out.append((key[0], at, entry is not None, entry[0] if entry else None, entry[2] if entry else None))
        if entry is None:
            if state.exists:
                state.remove()
        else:
            state.update(entry)
            state.setTimeoutTimestamp(max(entry[1] + ttl_ms + 1, state.getCurrentWatermarkMs() + 1))
        if out:
            found = pd.DataFrame(out, columns=["url", "at", "hit", "data", "hits"])
            yield found.astype({"hits": "Int64", "data": object})

    own = log.select("url", "kind", "data", "at").withWatermark("at", late)
    return own.groupBy("url").applyInPandasWithState(step, READS, "data string, at long, hits long", "append", "EventTimeTimeout")


def append_log(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each row of a stream once (a request, a read) to the log at ``path``, until what is there is done; a restart from the checkpoint goes on where it ended."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
