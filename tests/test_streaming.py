"""The stream on a folder table, on resuming, and without events."""

from palimpsest.operators import memory
from palimpsest.streaming.policies import stream_upsert_noop

EVENTS = "/root/testdata/sf0.001/events.parquet"


def rows(df):
    return sorted(map(tuple, df.select("user_id", "created", "updated", "text").collect()))


def test_folder_table_and_resume(spark, tmp_path):
    events = spark.read.parquet(EVENTS)
    middle = events.selectExpr("percentile_approx(ts, 0.5) AS ts").first()[0]
    folder, base = f"file://{tmp_path}/events", f"file://{tmp_path}/base"
    events.filter(events.ts <= middle).repartition(3).write.parquet(folder)
    half = rows(stream_upsert_noop(spark, folder, base=base))
    batch = lambda df: rows(memory.upsert_noop(memory.indexed(df, "user_id", "event_type", "ts", "event_id"), "user_id", "event_type", "ts"))
    assert half == batch(events.filter(events.ts <= middle))
    assert rows(stream_upsert_noop(spark, folder, base=base)) == half  # nothing new
    later = events.filter((events.ts > middle) & (events.user_id % 4 == 1))
    later.write.mode("append").parquet(folder)
    assert rows(stream_upsert_noop(spark, folder, base=base)) == batch(events.filter((events.ts <= middle) | (events.user_id % 4 == 1)))
    state = spark.read.parquet(f"{base}/state")
    last = state.filter(state.batch == state.selectExpr("max(batch) AS b").first().b)
    assert {r.user_id for r in last.collect()} == {r.user_id for r in later.collect()}  # a batch writes its own keys alone
    events.filter((events.ts > middle) & (events.user_id % 4 != 1)).write.mode("append").parquet(folder)
    assert rows(stream_upsert_noop(spark, folder, base=base)) == batch(events)


def test_no_events(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    spark.read.parquet(EVENTS).limit(0).write.parquet(folder)
    assert stream_upsert_noop(spark, folder, base=f"file://{tmp_path}/base").count() == 0
