"""Passages, library, context, retrieval, extraction, sources and streams."""

import json
import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from recollect.config import Settings
from recollect.functions.extract import readable, weight
from recollect.operators import chunking, index, retrieve
from recollect.operators import library as L
from recollect.plans import context as C
from recollect.sources import files
from recollect.streaming import streams

SEGS = "item_id string, seq long, text string, start double, end double"


def brute_segments(segs, most=420, overlap=80, seconds=90.0):
    out, buf = [], []
    flush = lambda: out.append((" ".join(t for t, _, _ in buf), buf[0][1], buf[-1][2] or buf[-1][1])) if len(" ".join(t for t, _, _ in buf)) >= 8 else None
    for t, s, e in segs:
        t = " ".join(t.split())
        if not t:
            continue
        if buf and (sum(len(x[0]) for x in buf) + len(t) > most or (e or s) - buf[0][1] > seconds):
            flush()
            carry, n = [], 0
            for x in reversed(buf):
                if n >= overlap:
                    break
                carry.insert(0, x)
                n += len(x[0])
            buf = carry if len(carry) < len(buf) else []
        buf.append((t, s, e))
    if buf:
        flush()
    return out


def test_segments(spark):
    r = random.Random(1)
    items = {"timed": [(f"word{i} " * r.randrange(1, 30), 3.0 * i, 3.0 * i + 3) for i in range(60)], "slow": [(f"slow {i}", 30.0 * i, 30.0 * i + 30) for i in range(12)], "one": [("x" * 5000, 0.0, 1.0)], "untimed": [("para " * r.randrange(40), 0.0, 0.0) for _ in range(30)], "tiny": [("a", 0.0, 0.0)]}
    rows = [(k, i, *s) for k, v in items.items() for i, s in enumerate(v)]
    r.shuffle(rows)
    got = {}
    for x in chunking.chunk_segments(spark.createDataFrame(rows, SEGS)).orderBy("item_id", "ordinal").collect():
        got.setdefault(x.item_id, []).append((x.text, x.start, x.end))
    assert got == {k: w for k, v in items.items() if (w := brute_segments(v))}
    assert len(got["one"]) == 1 and len(got["slow"]) > 2
    assert chunking.chunk_segments(spark.createDataFrame([], SEGS)).count() == 0


def test_sentences_pack(spark):
    df = spark.createDataFrame([("a", "好的。" * 200), ("b", "One. Two three. " * 3), ("c", None), ("d", "x" * 900)], "item_id string, text string")
    got = {}
    for r in chunking.chunk_text(df, 100).orderBy("item_id", "ordinal").collect():
        got.setdefault(r.item_id, []).append(r.text)
    assert len(got["a"]) > 1 and all(len(t) <= 140 for t in got["a"])
    assert got["b"] == ["One. Two three. One. Two three. One. Two three."] and got["d"] == ["x" * 900] and "c" not in got


def test_items(spark):
    seg = "array<struct<text:string,start:double,end:double>>"
    schema = f"item_id string, title string, author string, description string, folder string, tags array<string>, media_kind string, segments {seg}, comments array<struct<text:string,replies:array<string>>>"
    rows = [
        ("p", "Title", "", "excerpt of it", "fold", ["t1", "t2"], "post", [("body text of the post", 0.0, 0.0)], [("a good comment", ["yes"]), ("no", [])]),
        ("v", "Video", "Ann", "About this. More words here.", "", [], "video", [("first words said", 1.0, 2.0)], None),
        ("e", "Empty", None, None, None, [], "post", [], []),
    ]
    got = [(r.item_id, r.ordinal, r.kind, r.text, r.start) for r in chunking.chunk_items(spark.createDataFrame(rows, schema)).orderBy("item_id", "ordinal").collect()]
    assert got == [
        ("e", 0, "title", "Empty", 0.0),
        ("p", 0, "title", "Title · t1 t2 · fold", 0.0), ("p", 1, "body", "body text of the post", 0.0), ("p", 2, "comment", "a good comment ↳ yes", 0.0),
        ("v", 0, "title", "Video · Ann", 0.0), ("v", 1, "description", "About this. More words here.", 0.0), ("v", 2, "transcript", "first words said", 1.0),
    ]


def corpus(spark, n=60, seed=3):
    r = random.Random(seed)
    topics = [[f"t{k}w{i}" for i in range(12)] for k in range(6)]
    rows = []
    for i in range(n):
        t = topics[i % 6]
        for j in range(r.randrange(1, 6)):
            rows.append((f"{i:03d}:{j}", f"i{i:03d}", "s1" if i % 2 else "s2", "title" if j == 0 else "body", " ".join(r.choice(t) for _ in range(r.randrange(4, 12))) + f" only{i}"))
    chunks = index.tokenised(spark.createDataFrame(rows, "chunk_id string, item_id string, source string, kind string, text string"))
    qs = [(k, " ".join(topics[k][:5])) for k in range(6)] + [(90, "nothing known here"), (91, "  ")]
    queries = spark.createDataFrame(qs, "qid long, text string")
    toks = queries.withColumn("tokens", index.tokenize(F.col("text")))
    return rows, qs, index.Index.of(chunks, index.blake2b_vectors(chunks, 512, ("chunk_id",))), chunks, queries, index.blake2b_vectors(toks, 512, ("qid",))


def terms_of(queries):
    return index.query_terms(retrieve.asked_of(queries))


def test_bm25(spark):
    rows, qs, idx, _, queries, _ = corpus(spark)
    docs = {r[0]: r[4].split() for r in rows}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    want = {}
    for q, text in qs:
        for t in set(text.split()):
            own = {c: d.count(t) for c, d in docs.items() if t in d}
            if own and len(own) <= max(8, int(n * 0.35)):
                for c, tf in own.items():
                    idf = math.log(1 + (n - len(own) + 0.5) / (len(own) + 0.5))
                    want[q, c] = want.get((q, c), 0) + idf * tf * 2.4 / (tf + 1.4 * (0.28 + 0.72 * len(docs[c]) / avg))
    got = {(r.qid, r.chunk_id): r.score for r in retrieve.bm25_scores(idx, terms_of(queries)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)


def test_search(spark, tmp_path):
    rows, qs, idx, chunks, queries, qv = corpus(spark)
    hits = retrieve.search_chunks(idx, queries, qv, 40).collect()
    per = {}
    for h in hits:
        per.setdefault((h.qid, h.item_id), []).append(h)
    assert max(map(len, per.values())) <= 4 and max(h.hit for h in hits) <= 40
    found = retrieve.search_items(idx, queries, qv).collect()
    by = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        by.setdefault(r.qid, []).append(r)
    for k in range(6):  # each topic's items, and no others
        assert by[k] and all(int(r.item_id[1:]) % 6 == k for r in by[k]) and len(by[k]) <= 5
    assert 90 not in by and 91 not in by
    one = retrieve.search_items(idx, queries.where("qid = 2"), qv.where("qid = 2")).collect()
    assert sorted(map(str, one)) == sorted(map(str, by[2]))  # one query alone or among others
    kept = index.Index.write(chunks.repartition(7), index.blake2b_vectors(chunks.repartition(5), 512, ("chunk_id",)), f"{tmp_path}/index")
    again = retrieve.search_items(kept, queries, qv).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))  # stored or not, however it is dealt
    only = retrieve.search_items(index.Index.read(spark, f"{tmp_path}/index"), queries, qv, sources=["s1"]).collect()
    assert only and all(int(r.item_id[1:]) % 2 for r in only)
    assert not retrieve.search_items(kept, queries, qv, min_score=0.99).count()
    silent = spark.createDataFrame([(by[2][0].item_id,)], "item_id string")
    assert by[2][0].item_id not in {r.item_id for r in retrieve.search_items(kept, queries, qv, quiet=silent).collect() if r.qid == 2}
    assert {r.qid for r in retrieve.search_items(kept, queries, None).collect()} <= set(range(6))


def test_stored_search_reads_its_terms_alone(spark, tmp_path):
    """The filter on tokens reaches the files, for few terms and for many."""
    _, _, _, chunks, queries, _ = corpus(spark)
    kept = index.Index.write(chunks, index.blake2b_vectors(chunks, 512, ("chunk_id",)), f"{tmp_path}/index")
    plan = retrieve.bm25_scores(kept, terms_of(queries.where("qid = 2")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("In(token, [") == 2 and "PushedFilters: [In(token," in plan
    assert int(spark.conf.get("spark.sql.parquet.pushdown.inFilterThreshold")) >= index.GROUP
    want = {(r.qid, r.chunk_id): r.score for r in retrieve.bm25_scores(kept, terms_of(queries)).collect()}
    old, index.GROUP = index.GROUP, 2  # several scans
    try:
        assert {(r.qid, r.chunk_id): r.score for r in retrieve.bm25_scores(kept, terms_of(queries)).collect()} == want
    finally:
        index.GROUP = old
    old, index.NAMED = index.NAMED, 3
    try:
        assert {(r.qid, r.chunk_id): r.score for r in retrieve.bm25_scores(kept, terms_of(queries)).collect()} == want
    finally:
        index.NAMED = old


def test_confidence_by_passage(spark):
    """A passage without a comparable vector is judged by its words, others by both."""
    rows, _, _, chunks, queries, qv = corpus(spark)
    mixed = chunks.withColumn("comparable", F.col("chunk_id") < "030")
    vectors = index.blake2b_vectors(mixed.where("comparable"), 512, ("chunk_id",))
    idx = index.Index.of(mixed, vectors)
    hits = retrieve.search_chunks(idx, queries, qv)
    got = retrieve.with_confidence(hits, idx, terms_of(queries)).collect()
    assert {r.chunk_id < "030" for r in got} == {True, False}
    for r in got:
        d, c = max(0, min(1, r.dense)), r.coverage
        want = 0.55 * (0.45 * d + 0.55 * c) + 0.45 * math.sqrt(d * c) if r.chunk_id < "030" else 0.85 * c
        assert abs(r.confidence - want) < 1e-6


def test_confidence(spark):
    pairs = [(d / 10, c / 10) for d in range(-2, 13) for c in range(11)]
    got = [r.v for r in spark.createDataFrame(pairs, "d double, c double").coalesce(1).select(retrieve.confidence(F.col("d"), F.col("c")).alias("v")).collect()]
    for (d, c), v in zip(pairs, got, strict=True):
        d = max(0, min(1, d))
        assert 0 <= v <= 1 and abs(v - (0.55 * (0.45 * d + 0.55 * c) + 0.45 * math.sqrt(d * c))) < 1e-12


def test_coverage_scripts(spark):
    terms = [("redis", 2.0), ("持久", 3.0), ("cache", 1.0)]
    rows = [("redis and cache in english words", ["redis", "cache"]), ("持久化是数据库的功能之一", ["持久"]), ("ab", ["redis"]), ("no match in english", ["other"])]
    df = spark.createDataFrame([(t, k, terms) for t, k in rows], "t string, k array<string>, terms array<struct<token:string,weight:double>>").coalesce(1)
    got = [r.v for r in df.select(retrieve.coverage(F.col("terms"), F.col("k"), index.script_of(F.col("t"))).alias("v")).collect()]
    assert [round(x, 6) for x in got] == [round(2 / 2.8, 6), round(1 / 1.8, 6), round((2 / 6) / 1.8, 6), 0.0]


def test_dense_ties_and_blocks(spark):
    vec = spark.createDataFrame([(f"c{i:02d}", [i % 3], [1.0 if i % 2 else -1.0]) for i in range(40)] + [("none", [], [])], "chunk_id string, idx array<int>, val array<double>").repartition(4)
    q = spark.createDataFrame([(k, [k], [1.0]) for k in range(3)], "qid long, idx array<int>, val array<double>")
    want = sorted((k, f"c{i:02d}", 1.0 if i % 3 == k and i % 2 else (-1.0 if i % 3 == k else 0.0)) for k in range(3) for i in range(40))
    for block, most, size in ((2, 100, 7), (100, 100, 4096), (1, 0, 5)):
        got = index.dense_topk(index.packed(vec, size), q, 12, 3, block=block, most_broadcast=most).collect()
        assert len(got) == 36
        for k in range(3):
            own = sorted([(c, s) for kk, c, s in want if kk == k] + [("none", 0.0)], key=lambda x: (-x[1], x[0]))[:12]
            assert [(r.chunk_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.qid == k] == own


def test_federate(spark):
    s = "qid long, key string, rank int, n_chunks int, confidence double, payload string"
    a = spark.createDataFrame([(1, "x", 1, 1, 0.5, "a-x"), (1, "y", 2, 2, 0.5, "a-y")], s)
    b = spark.createDataFrame([(1, "y", 1, 1, 0.9, "b-y"), (1, "z", 2, 1, 0.5, "b-z")], s)
    got = retrieve.federate([a, b]).orderBy("rank").collect()
    assert [(r.key, r.origins, r.payload) for r in got] == [("y", [0, 1], "a-y"), ("x", [0], "a-x"), ("z", [1], "b-z")]
    assert [r.key for r in retrieve.federate([a, b.limit(0)]).orderBy("rank").collect()] == ["x", "y"]


ITEM = "id string, source string, title string, author string, description string, url string, folder string, media_kind string, saved_at double, indexed_at double, status string, user_tags array<string>, note string, status_at double, transcript_source string, has_transcript boolean"


def item(i, **k):
    base = {"id": f"s:{i}", "source": "s", "title": f"T{i}", "author": "", "description": "", "url": f"u{i}", "folder": "", "media_kind": "post", "saved_at": float(i), "indexed_at": 0.0, "status": "active", "user_tags": [], "note": "", "status_at": 0.0, "transcript_source": "", "has_transcript": False}
    return tuple((base | k).values())


def test_lifecycle(spark):
    items = spark.createDataFrame([item(1, user_tags=["a"]), item(2), item(3, status="muted")], ITEM)
    m = spark.createDataFrame([("s:1", "digested", [" b ", "a", "", "b"], None, "n", 5.0), ("s:2", None, None, ["zz"], None, 6.0), ("s:9", "muted", None, None, None, 7.0)], "id string, status string, add_tags array<string>, remove_tags array<string>, note string, at double")
    got = {r.id: (r.status, r.user_tags, r.note, r.status_at) for r in L.mark(items, m).collect()}
    assert got == {"s:1": ("digested", ["a", "b"], "n", 5.0), "s:2": ("active", [], "", 6.0), "s:3": ("muted", [], "", 0.0)}
    bad = spark.createDataFrame([("s:1", "wrong", None, None, None, 1.0)], m.schema)
    with pytest.raises(Exception, match="unknown status"):
        L.mark(items, bad).collect()
    assert {r.id for r in L.silenced(L.mark(items, m)).collect()} == {"s:1", "s:3"} and {r.id for r in L.silenced(L.mark(items, m), False).collect()} == {"s:3"}
    new = spark.createDataFrame([item(1, title="new", status="muted"), item(7)], ITEM)
    merged = {r.id: (r.title, r.status, r.user_tags) for r in L.upsert_items(L.mark(items, m), new).collect()}
    assert merged == {"s:1": ("new", "digested", ["a", "b"]), "s:2": ("T2", "active", []), "s:3": ("T3", "muted", []), "s:7": ("T7", "active", [])}
    assert sorted(map(str, L.upsert_items(L.upsert_items(items, new), new).collect())) == sorted(map(str, L.upsert_items(items, new).collect()))
    assert [r.id for r in L.list_items(items, limit=2, offset=1).collect()] == ["s:2", "s:1"]
    assert [r.id for r in L.list_items(items, tag="a", query="t1").collect()] == ["s:1"]
    assert [(r.tag, r.n) for r in L.tag_cloud(L.mark(items, m)).collect()] == [("a", 1), ("b", 1)]


def test_stats_of_nothing(spark):
    items = spark.createDataFrame([], ITEM)
    r = L.library_stats(items, spark.createDataFrame([], "kind string"), spark.createDataFrame([], "kind string, item_id string")).first()
    assert (r["items"], r.coverage, r.fire_rate, r.last_indexed_at) == (0, 0.0, 0.0, 0.0)


def test_hydration(spark):
    items = spark.createDataFrame([item(1, transcript_source="pending", title="u1"), item(2, transcript_source="pending", saved_at=0.5), item(3)], ITEM)
    assert [r.id for r in L.hydration_queue(items).collect()] == ["s:2", "s:1"]
    read = spark.createDataFrame([("s:1", "Read", "Who", True), ("s:2", "", "", False)], "id string, title string, author string, ok boolean")
    out = L.hydrated(items, read)
    assert {r.id: (r.title, r.author, r.transcript_source) for r in out.collect()} == {"s:1": ("Read", "Who", "capture"), "s:2": ("T2", "", "none"), "s:3": ("T3", "", "")}
    assert L.hydration_queue(out).count() == 0


def test_capture_summary(spark):
    rows = [(0, "added", True, None), (1, "added", True, None), (2, "skipped", True, None), (3, "failed", True, "capture needs a url")]
    r = L.capture_summary(spark.createDataFrame(rows, "seq long, state string, needs_body boolean, error string")).first()
    assert (r.added, r.updated, r.skipped, r.failed, r.needs_body, r.errors) == (2, 0, 1, 1, 3, ["capture needs a url"])


def test_relate(spark):
    rows, _, idx, chunks, _, _ = corpus(spark)
    items = spark.createDataFrame([item(i, id=f"i{i:03d}", status="muted" if i % 12 == 0 else "active") for i in range(60)], ITEM)
    ctx = "qid long, source string, source_id string, title string, author string, description string, tags array<string>"
    contexts = spark.createDataFrame([(1, "i", "x", "t0w0 t0w1 t0w2 t0w3 t0w4", "", "", []), (2, "", "", "", "", "", []), (3, "q", "9", "unheard of", "", "", [])], ctx)
    hits = C.relate(contexts, items, idx, lambda q: index.blake2b_vectors(q, 512, ("qid",)))
    got = hits.collect()
    assert got and {r.qid for r in got} == {1} and all(int(r.item_id[1:]) % 12 == 6 for r in got)
    why = {r.qid: (r.fired, r.reason_code) for r in C.reasons(contexts, hits, items).collect()}
    assert why == {1: (True, ""), 2: (False, "empty_context"), 3: (False, "no_match")}
    few = {r.qid: r.reason_code for r in C.reasons(contexts, hits, items.limit(3)).collect()}
    assert few == {1: "library_too_small", 2: "empty_context", 3: "library_too_small"}
    me = spark.createDataFrame([(1, "i", "", "t0w0 t0w1 t0w2", "", "", [])], ctx).withColumn("source_id", F.lit("x"))
    own = replace(idx, chunks=idx.chunks.withColumn("item_id", F.when(F.col("item_id") == got[0].item_id, "i:x").otherwise(F.col("item_id"))))
    assert "i:x" not in {r.item_id for r in C.relate(me, items, own, lambda q: index.blake2b_vectors(q, 512, ("qid",))).collect()}
    one = C.relate(contexts, items, idx, lambda q: index.blake2b_vectors(q, 512, ("qid",)), sources=["s1"]).collect()
    assert one == [] or all(int(r.item_id[1:]) % 2 for r in one)
    log = C.fired_events(contexts, hits, C.reasons(contexts, hits, items), F.lit(5.0)).collect()
    assert [(r.ts, r.kind, r.source, r.item_id) for r in log] == [(5.0, "fired", "i", min(got, key=lambda r: r["rank"]).item_id)]
    assert json.loads(log[0].payload) == {"watching": "t0w0 t0w1 t0w2 t0w3 t0w4", "matched": len(got)}


def test_relate_urls(spark):
    """Bare URLs: unknown, unreadable, stored itself, read anew."""
    _, _, idx, _, _, _ = corpus(spark)
    items = spark.createDataFrame([item(i, id=f"i{i:03d}") for i in range(60)] + [item(99, id="youtube:abcdefghijk", title="t3w0 t3w1 t3w2 t3w3 t3w4", author="", description="")], ITEM)
    urls = spark.createDataFrame([(1, ""), (2, "https://e.com/blank"), (3, "https://youtu.be/abcdefghijk"), (4, "https://e.com/read")], "qid long, url string")
    pages = spark.createDataFrame([(4, "t1w0 t1w1 t1w2 t1w3 t1w4", "", "")], "qid long, title string, author string, text string")
    hits, why = C.relate_urls(urls, items, idx, lambda q: index.blake2b_vectors(q, 512, ("qid",)), pages)
    assert {r.qid: r.reason_code for r in why.collect()} == {1: "unknown_url", 2: "page_unreadable", 3: "", 4: ""}
    assert {r.qid for r in hits.collect()} == {3, 4}
    hits, why = C.relate_urls(urls, items, replace(idx, chunks=idx.chunks.limit(0)), lambda q: index.blake2b_vectors(q, 512, ("qid",)), pages)
    assert {r.qid: r.reason_code for r in why.collect()} == {1: "unknown_url", 2: "page_unreadable", 3: "self_saved", 4: "no_match"}


def test_links_and_quotes(spark):
    schema = "media_kind string, source string, url string, chunks array<struct<kind:string,text:string,start:double>>"
    rows = [
        ("video", "youtube", "https://y/w?v=1", [("title", "t", 0.0), ("transcript", "said", 75.9)]), ("video", "bilibili", "https://b/v", [("transcript", "said", 75.0)]), ("video", "youtube", "https://y/w", [("transcript", "x", 0.0)]),
        ("post", "web", "https://p/a#old", [("title", "t", 0.0), ("comment", "a comment text", 0.0), ("body", "body text here", 0.0)]), ("post", "web", "https://p/a", [("comment", "a comment text", 0.0)]), ("post", "web", "https://p/a", [("title", "t", 0.0)]),
    ]
    df = spark.createDataFrame(rows, schema).coalesce(1)
    got = [r.v for r in df.select(C.deep_link(*map(F.col, ("media_kind", "source", "url", "chunks"))).alias("v")).collect()]
    assert got == ["https://y/w?v=1&t=75s", "https://b/v?t=75", "https://y/w", "https://p/a#:~:text=body%20text%20here", "https://p/a#:~:text=a%20comment%20text", "https://p/a"]
    rows = [([("comment", "c" * 30), ("body", "b" * 30)],), ([("title", "t" * 40), ("comment", "short comment here")],), ([("title", "t" * 40)],)]
    df = spark.createDataFrame(rows, "chunks array<struct<kind:string,text:string>>").coalesce(1)
    assert [r.v for r in df.select(C.quote(F.col("chunks"), F.array(F.lit("b")), F.lit("Title")).alias("v")).collect()] == ["b" * 30, "short comment here", "Title"]
    said = df.limit(1).select(C.explanation(F.lit(2), F.lit("A"), F.lit("Bo"), F.lit("q"), F.lit("english")).alias("e"), C.explanation(F.lit(2), F.lit("A"), F.lit(""), F.lit("q"), F.lit("数据库内容")).alias("z")).first()
    assert said.e == "You already saved 2 related item(s); the closest is “A” by Bo. From it: q" and said.z == "你收藏过 2 个相关内容，最接近的是《A》。其中提到：q"


def test_readable():
    body = "<p>" + "An article sentence of some length. " * 12 + "</p>"
    page = f'<html><head><title>Doc - Site</title><meta property="og:title" content="Doc"><meta name="author" content="Ann"></head><body><nav>{"<a href=x>menu entry</a>" * 40}</nav><div class="sidebar">{"<a href=y>related thing</a> " * 40}</div><div class="article-content"><script>var x;</script>{body}<br>Second &amp; last line.</div><div class="comments">{"chatter of readers " * 30}</div>'
    title, author, text, ok = readable(page)
    assert (title, author, ok) == ("Doc", "Ann", True) and text.startswith("An article") or "Second & last line." in text
    assert "menu" not in text and "chatter" not in text and "var x" not in text
    assert readable("<nav>only menus</nav>")[3] is False and readable(None) == ("", "", "", False) and readable("<div><p>un<b>closed")[3] is False
    assert weight("ab漢字") == 7


def test_csv_as_the_standard_library_reads_it(spark, tmp_path):
    import csv

    raw = 'title,url,intro\n"He said ""hi"", twice",https://e.com/1,x\nback\\slash\\,https://e.com/2,"ends in \\"\n"two\nlines, ""quoted""",https://e.com/3,\nplain,https://e.com/4,"a, b"\n'
    (tmp_path / "q.csv").write_text(raw)
    want = [(r["title"], r["url"], r["intro"]) for r in csv.DictReader(raw.splitlines(keepends=True))]
    got = files.as_items(files.read_csv(spark, f"{tmp_path}/q.csv")).orderBy("idx").select("title", "url", "description").collect()
    assert list(map(tuple, got)) == want and len(want) == 4
    whole = files.read_csv(spark, f"{tmp_path}/q.csv", line_breaks=False)
    assert [r.title for r in files.as_items(whole).orderBy("idx").collect()][:2] == [w[0] for w in want[:2]]


def test_files(spark, tmp_path):
    rows = [{"url": "https://youtu.be/abcdefghijk", "name": " N ", "transcript": [{"start": 1, "duration": 2, "text": "hi"}, "plain", {"text": "x", "start": 3, "end": 9}], "comments": ["c", {"text": "d", "likes": 4, "replies": ["r"]}], "tags": ["a", None, ""]}, {"id": "77", "title": "", "desc": "about", "saved_at": 5}]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    (tmp_path / "l.json").write_text(json.dumps(rows))
    (tmp_path / "o.json").write_text(json.dumps({"items": rows}))
    (tmp_path / "c.csv").write_text("title,link,playlist\nOne,https://e.com/a,F\n")
    (tmp_path / "u.txt").write_text("https://e.com/x\n# no\n\n e.com/y \n")
    for read in (files.read_jsonl(spark, f"{tmp_path}/a.jsonl"), files.read_json(spark, f"{tmp_path}/l.json"), files.read_json(spark, f"{tmp_path}/o.json")):
        a, b = files.as_items(read, stem="a", now=9.0).orderBy("idx").collect()
        assert (a.id, a.title, a.media_kind, a.tags, a.saved_at, a.folder) == ("youtube:abcdefghijk", "N", "video", ["a"], 9.0, "a")
        assert [tuple(s) for s in a.segments] == [("hi", 1.0, 3.0), ("plain", 0.0, 0.0), ("x", 3.0, 9.0)]
        assert [tuple(c) for c in a.comments] == [("c", "", 0, []), ("d", "", 4, ["r"])]
        assert (b.id, b.title, b.description, b.saved_at) == ("local:77", "Item 2", "about", 5.0)
    one = files.as_items(files.read_csv(spark, f"{tmp_path}/c.csv")).first()
    assert (one.title, one.folder, one.source) == ("One", "F", "web")
    urls = files.as_items(files.read_urls(spark, f"{tmp_path}/u.txt")).orderBy("idx").collect()
    assert [r.title for r in urls] == ["https://e.com/x", "e.com/y"]
    both = files.as_items(files.read_json(spark, f"{tmp_path}/*.json"))
    assert sorted((r.id, r.title, r.folder) for r in both.where("id <> 'youtube:abcdefghijk'").collect()) == [("local:77", "Item 2", "l"), ("local:77", "Item 2", "o")]
    (tmp_path / "x.jsonl").write_text('{"title": "p"}\n\n{"title": ""}')
    (tmp_path / "y.jsonl").write_text('{"title": "q"}\n{"title": "r"}')
    (tmp_path / "y.csv").write_text("title\nS\nT\n")
    (tmp_path / "z.csv").write_text("title\nU\n")
    (tmp_path / "v.txt").write_text("e.com/1\n#\ne.com/2")
    for rows_, n in ((files.read_jsonl(spark, f"{tmp_path}/[xy].jsonl"), 4), (files.read_csv(spark, f"{tmp_path}/[yz].csv"), 3), (files.read_urls(spark, f"{tmp_path}/[uv].txt"), 4)):
        found = files.as_items(rows_)
        assert found.count() == files.first_of_each(found).count() == n == found.select("id").distinct().count()
    named = {r.id: r.title for r in files.as_items(files.read_jsonl(spark, f"{tmp_path}/[xy].jsonl")).collect()}
    assert named == {"local:local-x-0": "p", "local:local-x-1": "Item 2", "local:local-y-0": "q", "local:local-y-1": "r"}
    with open(tmp_path / "big.txt", "w") as f:
        f.write("\n".join(f"https://e.com/{i:07d}" for i in range(60_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 200_000)
    try:
        lines = files.read_urls(spark, f"{tmp_path}/big.txt")
        assert lines.select(F.spark_partition_id()).distinct().count() > 1
        assert lines.where(F.try_variant_get("row", "$.url", "string") != F.format_string("https://e.com/%07d", "idx")).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    twice = files.as_items(files.read_jsonl(spark, f"{tmp_path}/a.jsonl")).unionByName(files.as_items(files.read_jsonl(spark, f"{tmp_path}/a.jsonl")).withColumn("idx", F.struct(F.concat(F.col("idx.path"), F.lit("~")).alias("path"), F.col("idx.idx").alias("idx"))))
    assert files.first_of_each(twice).count() == 2


def test_payloads(spark):
    df = spark.createDataFrame([('{"events":[{"tStartMs":1500,"dDurationMs":500,"segs":[{"utf8":"a "},{"utf8":"b"}]},{"segs":[{"utf8":"\\n"}]}]}', '{"body":[{"from":1,"to":2.5,"content":" hey "},{"content":""}]}')], "c string, b string")
    r = df.select(files.caption_segments(F.col("c")).alias("c"), files.subtitle_segments(F.col("b")).alias("b")).first()
    assert [tuple(x) for x in r.c] == [("a b", 1.5, 2.0)] and [tuple(x) for x in r.b] == [("hey", 1.0, 2.5)]
    d = spark.createDataFrame([("PT1H2M3S",), ("P1DT1S",), ("5 min",), ("",)], "t string").coalesce(1)
    assert [r.v for r in d.select(files.iso_seconds(F.col("t")).alias("v")).collect()] == [3723, 86401, 0, 0]
    d = spark.createDataFrame([("2024-01-02T03:04:05Z",), ("2024-01-02T03:04:05+08:00",), ("nope",)], "t string").coalesce(1)
    assert [r.v for r in d.select(files.rfc3339_seconds(F.col("t")).alias("v")).collect()] == [1704164645.0, 1704164645.0, 0.0]
    t = spark.createDataFrame([([("fr", False, "f"), ("en", True, "g"), ("en", False, "w")],)], "x array<struct<language:string,generated:boolean,url:string>>")
    assert t.select(files.best_track(F.col("x"), ["zh", "en"])).first()[0] == "w"


def fires(times, gap):
    last, out = None, []
    for t in times:
        on = last is None or t - last >= gap
        last = t if on else last
        out.append(on)
    return out


def test_cooldown(spark, tmp_path):
    r = random.Random(4)
    rows = sorted((k, i, r.randrange(10**9)) for i, k in enumerate(r.choices("abcd", k=200)))
    want = {}
    for k in "abcd":
        own = sorted((us, i) for kk, i, us in rows if kk == k)
        want |= {i: f for (_, i), f in zip(own, fires([u for u, _ in own], 10**7), strict=True)}
    df = spark.createDataFrame(rows, "key string, event_id long, us long")
    got = streams.cooldown(df.withColumn("ts", F.timestamp_micros("us")), 10).collect()
    assert {x.event_id: x.fires for x in got} == want
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    told = []

    def tell(name, batch, rows, ms):
        told.append((name, rows))
        raise RuntimeError("stops nothing")

    listener = streams.on_progress(spark, tell)
    q = streams.cooldown_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), 10).writeStream.format("memory").queryName("fires").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {x.event_id: x.fires for x in spark.sql("select * from fires").collect()} == want
    spark.streams.removeListener(listener)
    assert ("fires", 200) in told


def test_chunks_of_one_id(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 0, "z")], "chunk_id string, ordinal int, text string")
    assert {(r.chunk_id, r.text) for r in chunking.first_of_each_chunk(df).collect()} == {("a", "y"), ("b", "z")}


def test_fresh_pages(spark):
    rows = [("u", 1, "p"), ("u", 2, "p"), ("u", 3, None), ("u", 4, None), ("u", 5, "p"), ("v", 6, None)]
    df = spark.createDataFrame(rows, "key string, event_id long, page string").withColumn("ts", F.timestamp_seconds("event_id"))
    assert sorted(r.event_id for r in streams.fresh_pages(df).collect()) == [1, 3, 5, 6]


def test_cooldown_state_goes(spark, tmp_path):
    """Once the watermark has passed the time in which a fire can suppress anything, its state is dropped."""
    schema = "key string, event_id long, us long"
    for k, rows in enumerate(([("a", 1, 10**9), ("a", 2, 10**9 + 5 * 10**6)], [("b", 3, 10**10)], [("b", 4, 10**10 + 1)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = streams.cooldown_stream(source, 10, "1 second").writeStream.format("memory").queryName("gone").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.event_id: r.fires for r in spark.sql("select * from gone").collect()} == {1: True, 2: False, 3: True, 4: False}
    assert q.lastProgress.stateOperators[0].numRowsTotal == 1


def test_a_site_of_ones_own(spark):
    from recollect.functions import identity

    sites = (*identity.SITES, ("forum", "The Forum", ("forum.example.org",), r"/t/(\d+)"))
    df = spark.createDataFrame([("https://forum.example.org/t/42",)], "u string").coalesce(1)
    r = df.select(identity.identify(F.col("u"), sites).alias("w"), identity.label_of(F.lit("forum"), sites).alias("l")).first()
    assert (r.w.source, r.w.source_id, r.l) == ("forum", "42", "The Forum")


def test_ingest_stream(spark, tmp_path):
    a = spark.createDataFrame([item(1), item(2)], ITEM)
    b = spark.createDataFrame([item(2, title="again"), item(3)], ITEM)
    table = streams.VersionedTable(spark, f"{tmp_path}/table", ITEM)
    for n, df in enumerate((a, b)):
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        streams.ingest_stream(spark.readStream.schema(a.schema).parquet(f"{tmp_path}/in"), table, L.upsert_items, f"{tmp_path}/ck").awaitTermination(120)
    assert {r.id: r.title for r in table.read().collect()} == {"s:1": "T1", "s:2": "again", "s:3": "T3"}
    table.write(L.upsert_items(table.read(before=1), b), 1)  # a replay
    assert table.read().count() == 3


def test_debounce(spark):
    df = spark.createDataFrame([("k", 1, 0.0), ("k", 2, 1.0), ("k", 3, 5.0), ("j", 4, 0.5)], "key string, event_id long, s double").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted((r.key, r.event_id, r.n) for r in streams.debounce(df).collect()) == [("j", 4, 1), ("k", 2, 2), ("k", 3, 1)]


def test_settings():
    assert Settings().pool(40) == 160 and Settings().pool(5) == 64
