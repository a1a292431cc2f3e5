"""Pages from zones against the plain listing, and how little of it they read."""

import random

import pytest
from pyspark.sql import functions as F

from recollect.operators import library as L
from recollect.operators.listing import Listing

ITEM = "id string, source string, title string, author string, description string, saved_at double, indexed_at double, status string, user_tags array<string>, media_kind string, zone string"
N = 3000


@pytest.fixture(scope="module")
def items(spark):
    rng = random.Random(3)
    words = ["Ärger", "lamp", "好的 朋友", "İstanbul", "river", "x", "🙂🙃🙂", "stone"]
    rows = []
    for k in range(N):
        text = " ".join(rng.choice(words) for _ in range(4))
        title = [text, None, "", "Zebra crossing " + text][0 if k % 97 else rng.randint(1, 3)]
        # ties in both times go by id; a few items have no time at all
        rows.append((f"i{k:05d}", rng.choice("ab"), title, "Quagga" if k == 1700 else "Ann", "%_ 100 % sure" if k % 500 == 7 else text[::-1], None if k % 800 == 3 else float(k // 7), float(k % 2), rng.choice(["active", "muted"]), ["t"] if k % 50 == 0 else [], "post", "own"))
    return spark.createDataFrame(rows, ITEM).repartition(5).cache()


@pytest.fixture(scope="module")
def listing(items, tmp_path_factory):
    return Listing.write(items, str(tmp_path_factory.mktemp("listing") / "a"))


@pytest.mark.parametrize("how", [
    {}, {"offset": 20, "limit": 7}, {"offset": N - 5}, {"offset": N + 5}, {"query": "zebra"}, {"query": "QUAGGA"}, {"query": "% sure"}, {"query": "%_"}, {"query": "x"},
    {"query": "nowhere"}, {"query": "友"}, {"query": "的 朋友"}, {"query": "🙃🙂"}, {"query": "ärger"}, {"query": "İsta"}, {"query": "lamp", "status": "muted", "offset": 40},
    {"tag": "t", "offset": 30, "limit": 40}, {"source": "a", "media_kind": "post", "limit": 3}, {"status": "none"},
])
def test_as_the_plain_listing(items, listing, how):
    got = listing.page(stretch=500, **how).select("id", "title", "zone").collect()
    assert got == L.list_items(items, **how).select("id", "title", "zone").collect()
    if how.get("query") in ("zebra", "QUAGGA", "% sure"):
        assert got


def test_zones_are_skipped(listing):
    every = listing.zones("").count()
    assert every == listing.zones("ze").count() == -(-N // 32) and listing.n == N
    assert listing.zones("Quagga").count() == 1 and 0 < listing.zones("zebra").count() < every / 4 and listing.zones("nowhere").count() == 0
    assert listing.zones("lamp").count() == every


def test_pages_follow_each_other(items, listing):
    """Keyset paging: each page goes on from the place of the last item of the one before."""
    want, got, last = [r.id for r in L.list_items(items, tag="t", limit=N).collect()], [], -1
    while page := listing.page(tag="t", limit=17, after=last, stretch=100).collect():
        got += [r.id for r in page]
        last = page[-1]["_pos"]
    assert got == want and len(got) == 60


def test_a_page_is_a_range_of_places(listing):
    plan = listing.page(offset=2000, limit=10)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(_pos,2000)" in plan and "LessThan(_pos,2010)" in plan


def test_nothing_listed(items, tmp_path):
    none = Listing.write(items.limit(0), str(tmp_path / "none"))
    assert none.n == 0 and none.page().count() == 0 and none.page("lamp").count() == 0


def test_all_equal(items, tmp_path):
    """Rows that are alike in all that orders them but the id, in more zones than one; none of them holds text."""
    same = items.sparkSession.range(100).select(F.format_string("%03d", "id").alias("id"), *[F.lit(None).cast(t).alias(c) for c, t in (("source", "string"), ("title", "string"), ("author", "string"), ("description", "string"), ("saved_at", "double"), ("indexed_at", "double"), ("status", "string"), ("user_tags", "array<string>"), ("media_kind", "string"))])
    listed = Listing.write(same, str(tmp_path / "same"), 8)
    assert [r.id for r in listed.page(offset=90).collect()] == [f"{k:03d}" for k in range(90, 100)]
    assert listed.page("abc").count() == 0 and listed.zones("abc").count() == 0


def test_a_task_makes_signatures_of_so_many_items_at_most(items, monkeypatch):
    from recollect.operators import listing as own

    placed = own.counted(items, [o(F.col(c)) for o, c in own.ORDER], "_pos").withColumn("_zone", F.floor(F.col("_pos") / 32))
    whole = own.signatures(placed, N)
    monkeypatch.setattr(own, "AT_ONCE", 256)
    dealt = own.signatures(placed, N)
    assert dealt.rdd.getNumPartitions() == -(-N // 256) and whole.rdd.getNumPartitions() == 2
    assert {r._zone: (r.n, bytes(r.sign)) for r in dealt.collect()} == {r._zone: (r.n, bytes(r.sign)) for r in whole.collect()}
    none = items.limit(1).select(F.lit(0).cast("long").alias("_zone"), *[F.lit("ab").alias(c) for c in L.SEARCHED])
    assert [(r.n, r.sign) for r in own.signatures(none, 1).collect()] == [(1, None)]
