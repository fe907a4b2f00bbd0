import random

import pytest

from boardwise.operators import history
from boardwise.streaming import sessions


def test_stream_gives_the_batch_rows(spark, tmp_path):
    path = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(path)
    batch.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in")
    for f, name in ((sessions.windowed, "windows"), (sessions.sittings, "sittings")):
        q = f(stream).writeStream.format("memory").queryName(name).outputMode("append" if name == "sittings" else "complete").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        got, want = {str(r) for r in spark.table(name).collect()}, {str(r) for r in f(batch).collect()}
        assert got and got <= want and (name == "sittings" or got == want)


@pytest.fixture
def rocks(spark):
    from boardwise.streaming import ratings

    for k, v in ratings.PROVIDER.items():
        spark.conf.set(k, v)
    yield ratings
    for k in ratings.PROVIDER:
        spark.conf.unset(k)


def test_streamed_fold_equals_the_batch_over_a_restart(spark, rocks, tmp_path):
    r, rows = random.Random(4), []
    for pool in (0, 1):
        for d in range(12):
            for t in range(2):
                for seq in range(3):
                    a, b = r.sample([f"{pool}-{i}" for i in range(9)], 2)
                    rows.append((pool, f"2024-01-{d + 1:02d}T{18 + t}:00:00", f"t{t}", seq, a, b if seq else None, r.uniform(30, 70), r.choice([None, r.uniform(30, 75)]), len(rows)))
    schema = "series_id int, date string, tournament_id string, row_seq int, player1_id string, player2_id string, scratch_percentage double, handicap_percentage double, event_id int"
    end = [(p, "2024-03-01T00:00:00", "end", 0, None, None, 50.0, None, -1) for p in (0, 1)]  # moves the watermark on
    ordered = sorted(rows, key=lambda x: (x[1][:10], x[8] % 7))  # within a day in no order
    parts = [ordered[:50], ordered[50:57], ordered[57:100], ordered[100:] + [(0, None, "undated", 0, "0-1", "0-2", 50.0, None, -2)], end]

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        out = rocks.fold_stream(stream, ["series_id"], keep=["event_id"])
        out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination(300)

    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        if k in (1, 3, 4):  # stops and goes on from the checkpoint
            run()
    names = ["event_id", "series_id", *history.OUT]
    got = sorted(tuple(x[c] for c in names) for x in spark.read.parquet(f"{tmp_path}/out").where("event_id >= 0").collect())
    assert got == sorted(tuple(x[c] for c in names) for x in history.fold(spark.createDataFrame(rows, schema), by=["series_id"]).collect())
