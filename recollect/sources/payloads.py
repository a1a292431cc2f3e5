"""Captured API payloads (JSON strings) as rows: playlists, video details, favourites, caption tracks, comments.

Fetching is left to whoever captures them; every page of a listing is one row here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..config import Settings
from .files import iso_seconds, rfc3339_seconds

# The shapes that the sites give.
WATCH, BILI = "https://www.youtube.com/watch?v=", "https://www.bilibili.com/video/"
PLAYLIST = "items array<struct<snippet:struct<publishedAt:string,resourceId:struct<videoId:string>>,contentDetails:struct<videoId:string,videoPublishedAt:string>>>"
DETAILS = "items array<struct<id:string,snippet:struct<title:string,channelTitle:string,channelId:string,description:string,publishedAt:string,defaultAudioLanguage:string,defaultLanguage:string,tags:array<string>,thumbnails:struct<medium:struct<url:string>,high:struct<url:string>,default:struct<url:string>>>,contentDetails:struct<duration:string>>>"
SAID = "struct<textOriginal:string,textDisplay:string,likeCount:int,authorDisplayName:string>"
THREADS = f"items array<struct<snippet:struct<topLevelComment:struct<snippet:{SAID}>>,replies:struct<comments:array<struct<snippet:{SAID}>>>>>"
REPLY = "content:struct<message:string>,`like`:int,member:struct<uname:string>"
REPLIES = f"replies array<struct<{REPLY},replies:array<struct<{REPLY}>>>>"
#: The folder that is no folder: what is to be watched later, listed under another name.
LATER = "toview"
_MEDIUM = "struct<bvid:string,bv_id:string,title:string,intro:string,`desc`:string,cover:string,pic:string,duration:int,pubtime:double,pubdate:double,fav_time:double,add_at:double,upper:struct<name:string,mid:string>,owner:struct<name:string,mid:string>>"
MEDIA = f"medias array<{_MEDIUM}>,`list` array<{_MEDIUM}>"


def first_set(*cols: Column) -> Column:
    """The first that is neither null nor empty, else empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def first_number(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit(0.0)) for c in cols], F.lit(0.0))


def playlist_entries(pages: DataFrame) -> DataFrame:
    """(source_id, folder, saved_at, scan) from pages (folder, page, payload) of playlists in scan order: a video that
    several playlists hold counts for the first one. A payload that is no listing gives nothing."""
    rows = pages.select("folder", "page", F.posexplode(F.from_json("payload", PLAYLIST)["items"]).alias("at", "e"))
    rows = rows.select("folder", "page", "at", first_set(F.col("e.contentDetails.videoId"), F.col("e.snippet.resourceId.videoId")).alias("source_id"), rfc3339_seconds(first_set(F.col("e.snippet.publishedAt"), F.col("e.contentDetails.videoPublishedAt"))).alias("saved_at"))
    w = W.partitionBy("source_id").orderBy("page", "at")
    return rows.where("source_id <> ''").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def video_items(details: DataFrame, entries: DataFrame) -> DataFrame:
    """Saved videos: detail payloads (payload) joined with the playlist entries that name them."""
    v = details.select(F.explode(F.from_json("payload", DETAILS)["items"]).alias("v")).select("v.*")
    s = "snippet"
    rows = v.select(
        F.col("id").alias("source_id"), first_set(F.col(f"{s}.title")).alias("title"), F.concat(F.lit(WATCH), F.col("id")).alias("url"), first_set(F.col(f"{s}.channelTitle")).alias("author"), first_set(F.col(f"{s}.channelId")).alias("author_id"),
        first_set(F.col(f"{s}.description")).alias("description"), first_set(F.col(f"{s}.thumbnails.medium.url"), F.col(f"{s}.thumbnails.high.url"), F.col(f"{s}.thumbnails.default.url")).alias("thumbnail"),
        iso_seconds(first_set(F.col("contentDetails.duration"))).cast("int").alias("duration"), rfc3339_seconds(first_set(F.col(f"{s}.publishedAt"))).alias("published_at"),
        first_set(F.col(f"{s}.defaultAudioLanguage"), F.col(f"{s}.defaultLanguage")).alias("lang"), F.slice(F.coalesce(F.col(f"{s}.tags"), F.array().cast("array<string>")), 1, 25).alias("tags"),
    )
    return rows.join(entries.select("source_id", "folder", "saved_at"), "source_id").withColumn("source", F.lit("youtube")).withColumn("media_kind", F.lit("video"))


def favourite_items(pages: DataFrame, wanted: tuple[str, ...] = ()) -> DataFrame:
    """Saved videos from pages (folder, page, payload, and folder_id where folders are wanted by it) of favourites folders; the first
    folder that holds one counts, what is to be watched later (folder_id LATER) after all others. wanted: ids or titles of folders; none: all."""
    number = F.col("folder_id") if "folder_id" in pages.columns else F.lit("")
    pages = pages.withColumn("late", number == LATER)
    if wanted:
        pages = pages.where(number.isin(*wanted) | F.col("folder").isin(*wanted))
    payload = F.from_json("payload", MEDIA)
    m = pages.select("folder", "late", "page", F.posexplode(F.coalesce(payload["medias"], payload["list"])).alias("at", "m")).select("folder", "late", "page", "at", "m.*")
    cover = first_set(F.col("cover"), F.col("pic"))
    rows = m.select(
        "folder", "late", "page", "at", first_set(F.col("bvid"), F.col("bv_id")).alias("source_id"), first_set(F.col("title")).alias("title"), first_set(F.col("upper.name"), F.col("owner.name")).alias("author"), first_set(F.col("upper.mid"), F.col("owner.mid")).alias("author_id"),
        first_set(F.col("intro"), F.col("desc")).alias("description"), F.when(F.startswith(cover, F.lit("//")), F.concat(F.lit("https:"), cover)).otherwise(cover).alias("thumbnail"),
        F.coalesce("duration", F.lit(0)).alias("duration"), first_number(F.col("pubtime"), F.col("pubdate")).alias("published_at"), first_number(F.col("fav_time"), F.col("add_at")).alias("saved_at"),
    )
    w = W.partitionBy("source_id").orderBy("late", "page", "at")
    rows = rows.where("source_id <> ''").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "late")
    return rows.withColumn("url", F.concat(F.lit(BILI), F.col("source_id"))).withColumn("source", F.lit("bilibili")).withColumn("media_kind", F.lit("video")).withColumn("lang", F.lit("zh"))


def picked(comments: Column, cfg: Settings = Settings()) -> Column:
    """Of array<struct<text, author, likes, replies>> in scan order those worth keeping, the most liked first, with their first
    replies that are long enough: chunking.pick_comments() within one payload."""
    floor = max(6, cfg.comment_min_chars // 2)
    good = F.filter(comments, lambda c: (F.length(c["text"]) >= cfg.comment_min_chars) & (c["likes"] >= cfg.comment_likes))
    keyed = F.transform(good, lambda c, i: F.struct((-c["likes"]).alias("o"), i.alias("i"), c["text"].alias("text"), c["author"].alias("author"), c["likes"].alias("likes"), F.filter(F.slice(c["replies"], 1, cfg.replies), lambda r: F.length(r) >= floor).alias("replies")))
    return F.transform(F.slice(F.array_sort(keyed), 1, cfg.comments), lambda c: F.struct(c["text"].alias("text"), c["author"].alias("author"), c["likes"].alias("likes"), c["replies"].alias("replies")))


def thread_comments(payload: Column) -> Column:
    """Comments of a comment-thread payload."""
    none = F.array().cast("array<string>")
    said = lambda s: F.trim(first_set(s["textOriginal"], s["textDisplay"]))
    return F.transform(
        F.from_json(payload, THREADS)["items"],
        lambda t: F.struct(said(t["snippet"]["topLevelComment"]["snippet"]).alias("text"), first_set(t["snippet"]["topLevelComment"]["snippet"]["authorDisplayName"]).alias("author"), F.coalesce(t["snippet"]["topLevelComment"]["snippet"]["likeCount"], F.lit(0)).alias("likes"), F.coalesce(F.transform(t["replies"]["comments"], lambda c: said(c["snippet"])), none).alias("replies")),
    )


def reply_comments(payload: Column) -> Column:
    """Comments of a reply payload."""
    none = F.array().cast("array<string>")
    said = lambda c: F.trim(F.coalesce(c["content"]["message"], F.lit("")))
    return F.transform(F.from_json(payload, REPLIES)["replies"], lambda r: F.struct(said(r).alias("text"), first_set(r["member"]["uname"]).alias("author"), F.coalesce(r["like"], F.lit(0)).alias("likes"), F.coalesce(F.transform(r["replies"], said), none).alias("replies")))


def subtitle_track(tracks: Column) -> Column:
    """Of array<struct<lan, ai_status, url>> the URL of the best: written before generated, then Chinese first."""
    keyed = F.transform(tracks, lambda t, i: F.struct(((F.coalesce(t["ai_status"], F.lit(0)) != 0) | F.startswith(F.lower(t["lan"]), F.lit("ai-"))).alias("g"), (~F.lower(t["lan"]).rlike("^(ai-)?zh")).alias("o"), i.alias("i"), t["url"].alias("url")))
    return F.array_min(keyed)["url"]


def balanced_json(html: Column, name: str) -> Column:
    """The JSON object that a page's script assigns to name, found by its braces; null if there is none or it never closes."""

    def find(pages):
        import re

        start = re.compile(re.escape(name) + r"\s*=\s*(?=\{)")
        token = re.compile(r'"(?:[^"\\]|\\.)*"|[{}]', re.S)

        def one(page):
            m = start.search(page or "")
            depth = 0
            for t in token.finditer(page, m.end()) if m else ():
                depth += {"{": 1, "}": -1}.get(t[0], 0)
                if not depth:
                    return page[m.end() : t.end()]
            return None

        return pages.map(one)

    return F.pandas_udf(find, StringType())(html)
