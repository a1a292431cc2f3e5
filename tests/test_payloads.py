"""Captured payloads, vector upkeep and SQL names."""

import json

from pyspark.sql import functions as F

from recollect.functions.sql import register
from recollect.operators import library as L
from recollect.sources import payloads as P


def test_playlists(spark):
    e = lambda v, at="2024-01-01T00:00:00Z": {"snippet": {"publishedAt": at}, "contentDetails": {"videoId": v}}
    pages = [("LL", 0, json.dumps({"items": [e("a"), e("b")]})), ("PL", 1, json.dumps({"items": [e("b"), e("c"), {"snippet": {"resourceId": {"videoId": "d"}}}, {}]})), ("WL", 2, "forbidden")]
    entries = P.playlist_entries(spark.createDataFrame(pages, "folder string, page int, payload string"))
    assert {(r.source_id, r.folder) for r in entries.collect()} == {("a", "LL"), ("b", "LL"), ("c", "PL"), ("d", "PL")}
    video = {"id": "b", "snippet": {"title": "T", "channelTitle": "Ch", "thumbnails": {"high": {"url": "h"}}, "publishedAt": "2024-01-02T00:00:00+09:00", "defaultLanguage": "en", "tags": [str(i) for i in range(30)]}, "contentDetails": {"duration": "PT1M1S"}}
    r = P.video_items(spark.createDataFrame([(json.dumps({"items": [video, {"id": "zz"}]}),)], "payload string"), entries).collect()
    assert [(x.source_id, x.title, x.duration, x.folder, x.thumbnail, x.lang, len(x.tags), x.published_at) for x in r] == [("b", "T", 61, "LL", "h", "en", 25, 1704153600.0)]


def test_favourites(spark):
    m = {"medias": [{"bvid": "BV1", "title": "t", "cover": "//c/x.jpg", "upper": {"name": "u", "mid": 7}, "duration": 9, "fav_time": 5}, {"title": "gone"}, {"bv_id": "BV2", "intro": "", "desc": "d", "pubdate": 3}]}
    got = P.favourite_items(spark.createDataFrame([("f", 0, json.dumps(m)), ("g", 1, json.dumps(m))], "folder string, page int, payload string")).orderBy("source_id").collect()
    assert [(r.source_id, r.folder, r.thumbnail, r.author, r.description, r.saved_at, r.published_at) for r in got] == [("BV1", "f", "https://c/x.jpg", "u", "", 5.0, 0.0), ("BV2", "f", "", "", "d", 0.0, 3.0)]


def test_folders_wanted_and_watch_later(spark):
    one = lambda *ids: [{"bvid": i, "title": i} for i in ids]
    pages = [("later", "toview", 0, json.dumps({"list": one("BV1", "BV9")})), ("f", "11", 1, json.dumps({"medias": one("BV1")})), ("g", "12", 2, json.dumps({"medias": one("BV3")}))]
    df = spark.createDataFrame(pages, "folder string, folder_id string, page int, payload string")
    folders = lambda *wanted: {r.source_id: r.folder for r in P.favourite_items(df, wanted).collect()}
    assert folders() == {"BV1": "f", "BV9": "later", "BV3": "g"}
    assert folders("12", "later") == {"BV1": "later", "BV9": "later", "BV3": "g"} and folders("f") == {"BV1": "f"}


def test_comments(spark):
    top = lambda t, n: {"snippet": {"topLevelComment": {"snippet": {"textOriginal": t, "likeCount": n, "authorDisplayName": "a"}}}, "replies": {"comments": [{"snippet": {"textDisplay": " a fair reply "}}, {"snippet": {"textOriginal": "ok"}}, {"snippet": {"textOriginal": "third is too late"}}]}}
    threads = {"items": [top("liked by a few people", 5), top("short", 99), top("liked by nobody at all", 0), top("liked by many people", 50), top("as many, but later on", 5)]}
    replies = {"replies": [{"content": {"message": "a comment of some length"}, "like": 4, "member": {"uname": "u"}, "replies": [{"content": {"message": "a reply too"}}]}, {"content": None, "like": 9}]}
    r = spark.createDataFrame([(json.dumps(threads), json.dumps(replies))], "t string, r string").select(P.picked(P.thread_comments(F.col("t"))).alias("t"), P.picked(P.reply_comments(F.col("r"))).alias("r")).first()
    assert [(c.text, c.likes, c.replies) for c in r.t] == [("liked by many people", 50, ["a fair reply"]), ("liked by a few people", 5, ["a fair reply"]), ("as many, but later on", 5, ["a fair reply"])]
    assert [(c.text, c.author, c.replies) for c in r.r] == [("a comment of some length", "u", ["a reply too"])]


def test_tracks(spark):
    t = [("en", 0, "e"), ("ai-zh", 1, "az"), ("zh-CN", 0, "z")]
    df = spark.createDataFrame([(t,), (t[:2],), (t[1:2],)], "t array<struct<lan:string,ai_status:int,url:string>>").coalesce(1)
    assert [r[0] for r in df.select(P.subtitle_track(F.col("t"))).collect()] == ["z", "e", "az"]


def test_vectors_upkeep(spark):
    chunks = spark.createDataFrame([("a",), ("b",), ("c",)], "chunk_id string")
    vectors = spark.createDataFrame([("a", "x:1"), ("b", "y:1")], "chunk_id string, embedder string")
    assert sorted(r.chunk_id for r in L.stale_vectors(chunks, vectors, "x:1").collect()) == ["b", "c"]
    assert tuple(L.vector_coverage(chunks, vectors, "x:1").first()) == (3, 1, 0.3333)
    items = spark.createDataFrame([("1",), ("2",)], "id string")
    assert [r.id for r in L.lookup(items, spark.createDataFrame([("2",), ("2",), ("9",)], "id string")).collect()] == ["2"]


def test_sql_names(spark):
    register(spark)
    assert spark.sql("select normalize_text(' ＡＢ  ﬁ ') as n, normalize_text(null) as e, nfkc(cast(null as string)) as z").first() == ("ab fi", "", None)
    r = spark.sql("select nfkc('ＡＢ') as n, extract_readable('<title>T</title>').title as t").first()
    assert (r.n, r.t) == ("AB", "T")


def test_balanced_json(spark):
    pages = ['<script>var player = {"a":{"b":"}\\"{"},"c":1}; var x = {};</script>', "player = {", "nothing", None]
    df = spark.createDataFrame([(p,) for p in pages], "h string").coalesce(1)
    assert [r[0] for r in df.select(P.balanced_json(F.col("h"), "player")).collect()] == ['{"a":{"b":"}\\"{"},"c":1}', None, None, None]


def test_small_things(spark):
    meta = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    assert {tuple(r) for r in L.upsert_meta(meta, spark.createDataFrame([("b", "3")], meta.schema)).collect()} == {("a", "1"), ("b", "3")}
    assert [L.clamp(n, *L.BOUNDS["search"]) for n in (0, 7, 99)] == [1, 7, 50]
    from recollect.operators import index

    assert index.choose_embedder("no such") is index.blake2b_vectors and index.choose_embedder("sql-hash") is index.hashed
    assert meta.select(index.prefixed(F.col("value"), "query")).first()[0] == "query: 1"


def test_sql_names_agree_with_columns(spark):
    """What SQL calls by name gives what the columns give."""
    from recollect.functions.identity import canonical_url
    from recollect.functions.text import normalize, tokenize

    register(spark)
    texts = [None, "", "self-attention in GPT-4.5 vs node_js", "向量数据库入门 ﬁne ｶﾅ", "the of and", "x.y.z --- ___ it's"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    df.createOrReplaceTempView("texts")
    got = {r.i: (r.k, r.n) for r in spark.sql("select i, tokenize(t) k, normalize_text(t) n from texts").collect()}
    assert got == {r.i: (r.k, r.n) for r in df.select("i", tokenize(F.col("t")).alias("k"), normalize(F.col("t")).alias("n")).collect()}
    urls = [None, " ", "Example.com", "http://user@WWW.e.com:8080/a//?b=1&utm_source=x&c=%zz&d=a+b*~&&=3#f", "https://e.com:443/?q=%E6%BC%A2", "e.com/p?x", "ftp://www.e.com:080"]
    df = spark.createDataFrame(list(enumerate(urls)), "i int, u string")
    df.createOrReplaceTempView("urls")
    assert {r.i: r.c for r in spark.sql("select i, canonical_url(u) c from urls").collect()} == {r.i: r.c for r in df.select("i", canonical_url(F.col("u")).alias("c")).collect()}
    segments = [("first words said here", 0.0, 3.0), ("", 3.0, 4.0), ("and more of them " * 30, 4.0, 9.0)]
    spark.createDataFrame([("a", segments), ("b", [])], "id string, segments array<struct<text:string,start:double,end:double>>").createOrReplaceTempView("said")
    rows = spark.sql("select id, c.* from said, lateral chunk_segments(segments) c order by ordinal").collect()
    assert [(r.id, r.ordinal, r.start, r.end) for r in rows] == [("a", 0, 0.0, 3.0), ("a", 1, 4.0, 9.0)]
