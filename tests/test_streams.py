"""Stateful streams with timers: late rows, restarts, keys with very many rows in a trigger, state that goes; each against its batch form."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from recollect.streaming import streams

BASE = 1_700_000_000_000_000
SCHEMA = "key string, event_id long, us long, page string"


@pytest.fixture
def feed(spark, tmp_path):
    """Write files one after the other and read them as a stream, one a trigger."""
    class Feed:
        n = 0

        def put(self, rows):
            self.n += 1
            part = tmp_path / f"part{self.n}"
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(part))
            (tmp_path / "in").mkdir(exist_ok=True)
            for f in part.glob("*.parquet"):
                shutil.move(f, tmp_path / "in" / f"{self.n:04d}.parquet")

        def run(self, make):
            source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            q = make(source).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
            q.awaitTermination()
            return q

        def out(self):
            return spark.read.parquet(str(tmp_path / "out"))

    return Feed()


def events(seed, n, keys=5, step=60):
    r = random.Random(seed)
    us, rows = BASE, []
    for i in range(n):
        us += r.randrange(step * 1_000_000)
        rows.append((f"k{r.randrange(keys)}", i, us, r.choice(["a", "a", "b", None])))
    return rows


END = [("end", 10**6, BASE + 10**13, "z")]


def as_table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_micros("us"))


@pytest.mark.parametrize("restart", [False, True])
def test_late_rows_in_order(spark, feed, restart):
    """Rows that come late within the delay give what the table gives, also when the query starts again between files."""
    rows = events(1, 240)
    r = random.Random(2)
    files = [[] for _ in range(6)]
    for k, row in enumerate(rows):
        files[min(5, k // 40 + (r.random() < 0.2))].append(row)  # a fifth comes a file late
    cool = lambda s: streams.cooldown_stream(s, 600, "60 minutes", in_order=True)
    for k, f in enumerate(files):
        r.shuffle(f)
        feed.put(f)
        if restart and k % 2:
            feed.run(cool)
    feed.put(END)
    feed.run(cool)
    want = {x.event_id: x.fires for x in streams.cooldown(as_table(spark, rows), 600).collect()}
    assert {x.event_id: x.fires for x in feed.out().where("key <> 'end'").collect()} == want and set(want.values()) == {True, False}


def test_pages_in_order_and_late_ones(spark, feed):
    rows = events(3, 200)
    fresh = lambda s: streams.fresh_pages_stream(s, 10**6, "60 minutes")
    early, late = rows[:100], rows[60:80]
    feed.put([x for x in early if x not in late])
    feed.put(late + rows[100:])
    feed.run(fresh)
    feed.put(END + [("k0", 999, BASE, "too late")])
    feed.run(fresh)
    feed.put([("k0", 1000, BASE, "far too late"), ("end", 10**6 + 1, BASE + 2 * 10**13, "y")])
    feed.run(fresh)
    want = sorted((x.event_id, x.page) for x in streams.fresh_pages(as_table(spark, rows)).collect())
    got = sorted((x.event_id, x.page) for x in feed.out().where("key <> 'end' and event_id < 900").collect())
    assert sorted(got, key=str) == sorted(want, key=str) and 20 < len(want) < 200
    assert not feed.out().where("event_id = 1000").count()


def test_a_key_with_very_many_rows(spark, feed):
    r = random.Random(4)
    rows = [("hot", i, BASE + r.randrange(10**11), "a") for i in range(100_000)] + [("cold", 10**5 + 5, BASE, "a")]
    feed.put(rows)
    feed.put(END)
    q = feed.run(lambda s: streams.cooldown_stream(s, 600, "10 minutes"))
    want = {x.event_id for x in streams.cooldown(as_table(spark, rows), 600).where("fires").collect()}
    assert {x.event_id for x in feed.out().where("fires and key <> 'end'").collect()} == want
    # the timers have taken away what can suppress nothing any more
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3
