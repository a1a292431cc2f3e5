"""Leased work: interleaved workers, one that dies, retries, and hydration that ends in the index."""

import os

from pyspark.sql import functions as F
from test_store import CFG, found

from recollect.plans.queue import Queue, hydrate_some
from recollect.plans.store import Store


def work(spark, *ids):
    return spark.createDataFrame([(i, float(k)) for k, i in enumerate(ids)], "id string, at double")


def names(rows):
    return sorted(r.id for r in rows.collect())


def test_two_workers_never_share_a_row(spark, tmp_path):
    """The second worker claims between the reading and the commit of the first, which looks again."""
    one, two = Queue(spark, str(tmp_path)), Queue(spark, str(tmp_path))
    assert one.add(work(spark, "a", "b", "c", "d", "e", "a", None)) == 5 and two.add(work(spark, "b", "z")) == 1
    commit, theirs = one.manifest.commit, []

    def later(*args):
        one.manifest.commit = commit
        theirs.append(two.claim("two", 3, now=10.0))
        theirs.append(two.claim("two", 1, now=10.0))  # by now the files that the first has read may be gone
        return commit(*args)

    one.manifest.commit = later
    mine = one.claim("one", 3, now=10.0)
    assert [r.id for r in theirs[0].orderBy("at", "id").collect()] == ["a", "b", "z"] and names(theirs[1]) == ["c"]
    assert names(mine) == ["d", "e"] and one.claim("one", 5, now=10.0).isEmpty()
    leases = [f for f in os.listdir(tmp_path / "leases") if not f.startswith("_")]
    assert len(leases) <= 2  # the last and the one before; the draft that lost is gone
    assert two.done("two", mine) == 0 and one.done("one", mine) == 2
    assert names(one.waiting()) == ["a", "b", "c", "z"]


def test_a_worker_that_dies(spark, tmp_path):
    q = Queue(spark, str(tmp_path), lease=60.0, tries=2)
    q.add(work(spark, "a", "b"))
    lost = q.claim("dead", 2, now=0.0)
    assert q.claim("heir", 2, now=59.0).isEmpty()
    taken = q.claim("heir", 2, now=60.0)
    assert names(taken) == ["a", "b"] and {r.tries for r in taken.collect()} == {2}
    assert q.done("dead", lost) == 0  # it wasn't dead after all, but what it held is another's
    assert q.done("heir", taken.where("id = 'a'")) == 1
    q.release("dead", lost)
    assert {r.worker: r.until for r in q.waiting().collect()} == {"heir": 120.0}
    q.release("heir", taken)
    assert q.claim("third", 2, now=61.0).isEmpty() and names(q.given_up()) == ["b"]


def test_done_rows_are_left_out_of_the_files(spark, tmp_path):
    q = Queue(spark, str(tmp_path))
    q.add(work(spark, *[f"i{k:02d}" for k in range(20)]))
    for n, (rows, gone) in enumerate([(20, 4), (12, 0)]):
        q.done("w", q.claim("w", 4, now=float(n)))
        held = q._held()[1]
        assert (held["rows"], held["gone"]) == (rows, gone)
    assert names(q.waiting()) == [f"i{k:02d}" for k in range(8, 20)]
    assert q.add(work(spark, "i00", "i19")) == 1  # what was done may come again, what is open stays
    assert names(q.claim("w", 1, now=9.0)) == ["i00"]


def test_nothing_to_do(spark, tmp_path):
    q = Queue(spark, str(tmp_path))
    assert q.claim("w", 5, now=0.0).isEmpty() and q.add(work(spark)) == 0 and q.waiting().isEmpty()
    assert q.done("w", spark.createDataFrame([], "id string, batch long")) == 0 and q.manifest.versions() == []


def test_links_end_in_the_index(spark, tmp_path):
    """Two workers hydrate a store; one dies after the store's commit, one page never comes, one can't be read."""
    root, schema = str(tmp_path / "store"), "idx long, url string, title string, author string, text string, excerpt string, folder string, tags array<string>, saved_at double, comments array<struct<text:string,author:string,likes:int,replies:array<string>>>"
    store = Store(spark, root, buckets=8, cfg=CFG)
    store.capture(spark.createDataFrame([(k, f"e.com/{n}", "", "", "", "", "", [], float(k), []) for k, n in enumerate(["gliders", "wall", "sourdough", "never"])], schema), now=1.0)
    links = {r.url.rsplit("/", 1)[-1]: r.id for r in store.table("items").where("transcript_source = 'pending'").collect()}
    assert len(links) == 4
    page = lambda n: "<article><h1>Head</h1><p>" + f"A page about {n} and what they need, told at length. " * 9 + "</p></article>"
    pages = spark.createDataFrame([(links["gliders"], page("gliders")), (links["wall"], "<html></html>"), (links["sourdough"], page("sourdough"))], "id string, html string")
    q = Queue(spark, str(tmp_path / "queue"), lease=10.0, tries=2)
    assert q.add(store.table("items").where("transcript_source = 'pending'").select("id", F.col("saved_at").alias("at"))) == 4

    # this one has indexed its two rows, and dies before it closes them
    dead = q.claim("dead", 2, now=2.0)
    Store(spark, root, cfg=CFG).hydrate(dead.select("id"), pages, 2.0)
    got = hydrate_some(spark, root, q, "live", pages, now=3.0, limit=5, cfg=CFG)
    assert (got["claimed"], got["closed"], got["indexed"]) == (2, 1, 1)  # the page that never comes goes back
    version = Store(spark, root, cfg=CFG).version
    got = hydrate_some(spark, root, q, "live", pages, now=12.0, limit=2, cfg=CFG)  # the lease of the dead has run out
    assert (got["claimed"], got["closed"], got["fetched"]) == (2, 2, 0) and Store(spark, root, cfg=CFG).version == version
    got = hydrate_some(spark, root, q, "live", pages, now=13.0, limit=5, cfg=CFG)
    assert (got["claimed"], got["closed"], got["failed"]) == (1, 1, 1) and q.waiting().isEmpty()

    last = Store(spark, root, cfg=CFG)
    state = {r.id: r.transcript_source for r in last.table("items").collect()}
    assert {n: state[i] for n, i in links.items()} == {"gliders": "capture", "wall": "none", "sourdough": "capture", "never": "none"}
    assert found(last, "gliders")[0] == links["gliders"] and found(last, "sourdough")[0] == links["sourdough"]
