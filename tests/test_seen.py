"""Address activity on streams: the same answers as over all rows at once, also after a restart."""

import random

import pytest
from pyspark.sql import functions as F

from vigilark.operators import activity
from vigilark.streaming import seen


@pytest.fixture
def rocks(spark):
    before = {k: spark.conf.get(k, None) for k in seen.SETTINGS}
    for k, v in seen.SETTINGS.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


SCHEMA = "log_uuid string, event_timestamp timestamp, source_ip string, dest_ip string"


def written_rows(spark, path, parts=4, n=400):
    """Rows over two days with one hot address, out of order within an hour, a file per part."""
    rng = random.Random(3)
    rows = [(f"u{i:04d}", i * 430 + rng.randint(-1700, 1700) + 10_000, rng.choice(["hot", f"a{rng.randint(0, 40)}", None]),
             rng.choice([f"b{rng.randint(0, 60)}", "", "hot"])) for i in range(n)]
    frames = []
    for p in range(parts):
        frame = spark.createDataFrame(rows[p * n // parts:(p + 1) * n // parts], "log_uuid string, s bigint, source_ip string, dest_ip string")
        frames.append(frame.select("log_uuid", F.timestamp_seconds("s").alias("event_timestamp"), "source_ip", "dest_ip"))
    return rows, frames


def test_stream_equals_all_rows_at_once(rocks, tmp_path):
    spark = rocks
    rows, frames = written_rows(spark, tmp_path)
    source, out, checkpoint = str(tmp_path / "rows"), str(tmp_path / "out"), str(tmp_path / "cp")
    for part, frame in enumerate(frames):
        frame.coalesce(1).write.mode("append").parquet(source)
        if part == 0:
            continue  # two files in the first run, then a restart for each
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        query = (seen.seen_before(stream).writeStream.format("parquet").outputMode("append").option("path", out)
                 .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        query.awaitTermination(240)
    stored = spark.read.schema(SCHEMA).parquet(source)
    newest = max(r[1] for r in rows)
    settled = stored.filter(F.unix_micros("event_timestamp") < (newest - 3600) * 1_000_000).select("log_uuid")
    want = {tuple(r) for r in activity.sightings_seen(stored).join(settled, "log_uuid").collect()}
    got = [tuple(r) for r in spark.read.parquet(out).collect()]
    assert len(got) == len(set(got))
    below = {r.log_uuid for r in settled.collect()}
    assert {g for g in got if g[0] in below} == want and {w[2] for w in want} == {True, False}
    # What is left in the state is at most four hours behind the watermark.
    held = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "first").load()
    hours = [r.hour for r in held.select("user_map_key.hour").collect()]
    assert hours and min(hours) >= (newest - 3600) // 3600 - activity.ACTIVITY_HOURS
