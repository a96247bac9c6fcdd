from __future__ import annotations

from pyspark.sql import functions as F

from marquee.operators import dedupe
from marquee.sources import writers
from marquee.streaming import feeds


def test_feed_and_windows(spark, tmp_path):
    rows = [(1, "a.jpg", None, "2024-01-01 00:00:00"), (2, "", None, "2024-01-01 00:01:00"), (1, "a.jpg", None, "2024-01-01 00:02:00"), (3, "b.jpg", True, "2024-01-01 00:03:00")]
    events = spark.createDataFrame(rows, "event_id long, imageUrl string, thumbnailGenerated boolean, at string").withColumn("scrapedAt", F.to_timestamp("at")).drop("at")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    seen = []
    q = feeds.run_actions(feeds.once_each(feeds.needing_action(stream)), lambda df, _: seen.extend(r.event_id for r in df.collect()), str(tmp_path / "check"))
    q.awaitTermination()
    assert seen == [1]
    assert [r.event_id for r in feeds.recent(events, "2024-01-01 00:06:30").collect()] == [1, 3]
    log = events.select(F.col("scrapedAt").alias("ts"), F.lit("d").alias("domain"), F.lit(1).alias("success"))
    assert feeds.request_windows(log, "5 minutes", "5 minutes").first().requests == 4


def test_sinks(spark, tmp_path):
    events = spark.createDataFrame([(1, "events", "T", "2024-01-01", "v", "19:00", True, 5, 1), (2, "events", "t ", "2024-01-01", "V", "19:00", False, 9, 2), (3, "x", "", "2024-01-01", "v", "", False, 1, 3)], "event_id long, collection string, title string, date string, venue string, startTime string, has_image boolean, created long, ord long")
    gone = dedupe.ranked(events).filter("status = 'DELETE'")
    assert [r.event_id for r in gone.collect()] == [2]
    kept = writers.delete(events, gone, ["collection", "event_id"])
    assert sorted(r.event_id for r in kept.collect()) == [1, 3] == sorted(r.event_id for r in dedupe.without_deleted(events).collect())
    assert writers.backup(events, str(tmp_path / "b"), "now").first().total_events == 3
    writers.report(kept.groupBy("venue").count(), str(tmp_path / "r"), "now")
    assert {(r.venue, r["count"], r.timestamp) for r in spark.read.json(str(tmp_path / "r")).collect()} == {("v", 2, "now")}
    writers.append_routed(kept, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).filter("collection = 'x'").count() == 1


def test_cache_stream_with_expiry_hits_and_restart(spark, tmp_path):
    """A stream of writes and reads says what a replay of the same rows says, over a restart from its checkpoint; state of old entries goes."""
    schema = "url string, kind string, data string, at timestamp"
    files, check, out = str(tmp_path / "in"), str(tmp_path / "check"), str(tmp_path / "out")

    def send(*rows):
        spark.createDataFrame([(u, k, d, f"2024-01-01 {t}") for u, k, d, t in rows], "url string, kind string, data string, t string").selectExpr("url", "kind", "data", "to_timestamp(t) AS at").coalesce(1).write.mode("append").parquet(files)
        q = feeds.append_log(feeds.cached_reads(spark.readStream.schema(schema).parquet(files), 600_000, "5 minutes"), out, check)
        q.awaitTermination()
        return q.lastProgress

    send(("a", "get", None, "00:00:00"), ("a", "set", "one", "00:01:00"), ("a", "get", None, "00:02:00"), ("b", "set", "bee", "00:01:00"))
    send(("a", "get", None, "00:11:00"), ("a", "get", None, "00:11:01"), ("a", "get", None, "00:11:02"), ("b", "get", None, "00:05:00"))
    send(("a", "set", "two", "00:12:00"), ("a", "get", None, "00:12:00"), ("c", "get", None, "00:12:00"), ("a", "set", "three", "00:13:00"), ("a", "get", None, "00:13:30"))
    last = send(("z", "get", None, "03:00:00"))
    last = send(("z", "get", None, "03:00:01"))
    got = sorted((r.url, str(r.at)[11:], r.hit, r.data, r.hits) for r in spark.read.parquet(out).collect() if r.url != "z")
    assert got == [
        ("a", "00:00:00", False, None, None), ("a", "00:02:00", True, "one", 1), ("a", "00:11:00", True, "one", 2), ("a", "00:11:01", False, None, None), ("a", "00:11:02", False, None, None), ("a", "00:12:00", True, "two", 1), ("a", "00:13:30", True, "three", 1),
        ("b", "00:05:00", True, "bee", 1), ("c", "00:12:00", False, None, None),
    ]
    assert sum(s["numRowsTotal"] for s in last["stateOperators"]) == 0


def test_replay_like_a_loop(spark):
    import random

    from marquee.operators.requests import replayed

    rng = random.Random(3)
    rows = [(i, rng.choice("abc"), rng.choice(["get", "get", "set"]), f"d{i}", rng.randrange(200)) for i in range(300)]
    got = {r.ord: (r.hit, r.data, r.hits) for r in replayed(spark.createDataFrame(rows, "ord long, url string, kind string, data string, at long"), 20).collect()}
    entries, want = {}, {}
    for i, url, kind, data, at in sorted(rows, key=lambda r: (r[4], r[0])):
        if kind == "set":
            entries[url] = [data, at, 0]
        elif url in entries and at - entries[url][1] <= 20:
            entries[url][2] += 1
            want[i] = (True, entries[url][0], entries[url][2])
        else:
            want[i] = (False, None, None)
    assert got == want
