"""Saved-content files and captured payloads as DataFrames of one schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.identity import canonical_url, identify

#: Spellings of each field, the first that is set wins.
ALIASES = {
    "title": ("title", "name", "video_title"),
    "url": ("url", "link", "video_url", "href"),
    "author": ("author", "channel", "uploader", "up", "owner"),
    "description": ("description", "desc", "intro", "summary", "note", "notes"),
    "folder": ("folder", "playlist", "collection", "category"),
    "thumbnail": ("thumbnail", "cover", "image", "pic"),
}
SEGMENTS = "array<struct<text:string,start:double,end:double>>"
COMMENTS = "array<struct<text:string,author:string,likes:int,replies:array<string>>>"



#: Where a scan's row comes from: the file's name without its ending, the row's number in the file, its place among all rows.
PLACE = ("file", "idx", "scan")


def numbered(rows: DataFrame) -> DataFrame:
    """rows (path, block, n, row) with file, idx and scan for path, block and n.

    A file comes in blocks (splits), n grows within each; the row's number in its file counts from 0. Rows are counted block
    by block, and a running sum over blocks, one row for each split, places them, so that no file is one task's work.
    scan orders all rows: by path, then by place."""
    placed = rows.withColumn("nth", F.row_number().over(W.partitionBy("path", "block").orderBy("n")) - 1)
    blocks = rows.groupBy("path", "block").count()
    before = F.coalesce(F.sum("count").over(W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = placed.join(blocks.select("path", "block", before.alias("before")), ["path", "block"]).withColumn("idx", (F.col("before") + F.col("nth")).cast("long"))
    stem = F.regexp_replace(F.try_url_decode(F.element_at(F.split("path", "/"), -1)), r"(?<=.)\.[^.]*$", "")
    return out.select(stem.alias("file"), "idx", F.struct("path", "idx").alias("scan"), "row")


def place() -> list[Column]:
    """path, block and n of a line that is being read: ids grow along a split."""
    return [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")]


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, n, v) of every line."""
    return spark.read.text(path).select(*place(), F.trim("value").alias("v"))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(file, idx, scan, row): every line that is not blank, a JSON object as variant."""
    return numbered(file_lines(spark, path).where("v <> ''").select("path", "block", "n", F.parse_json("v").alias("row")))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """(file, idx, scan, row) of whole-file JSON: a list, or an object that has it under items."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.parse_json("value").alias("doc"))
    items = F.coalesce(F.try_variant_get("doc", "$.items", "array<variant>"), F.try_variant_get("doc", "$", "array<variant>"))
    return numbered(whole.select("path", F.lit(0).alias("block"), F.posexplode(items).alias("n", "row")))


def read_csv(spark: SparkSession, path: str, line_breaks: bool = True) -> DataFrame:
    """(file, idx, scan, row) of CSV with a header (one for all files), all values strings: a doubled quote in a quoted field is a quote, a backslash is
    itself, a quoted field may hold line breaks. A file whose fields hold none can be split among tasks: set line_breaks to False."""
    df = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=line_breaks)
    return numbered(df.select(*place(), F.parse_json(F.to_json(F.struct(*df.columns))).alias("row")))


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    """(file, idx, scan, row) of a list of URLs; blank lines and # lines drop out."""
    lines = file_lines(spark, path).where("v <> '' and v not like '#%'")
    return numbered(lines.select("path", "block", "n", F.parse_json(F.to_json(F.struct(F.col("v").alias("url"), F.col("v").alias("title")))).alias("row")))


READERS = {"jsonl": read_jsonl, "json": read_json, "csv": read_csv, "txt": read_urls}


def get(name: str, kind: str = "string") -> Column:
    return F.try_variant_get("row", f"$.{name}", kind)


def pick(field: str) -> Column:
    return F.coalesce(*[F.nullif(F.trim(get(a)), F.lit("")) for a in ALIASES[field]], F.lit(""))


def segments_of(row: str = "row") -> Column:
    """Transcript rows: a string is untimed; a record ends at end or after duration."""
    rows = F.coalesce(F.try_variant_get(row, "$.transcript", "array<variant>"), F.try_variant_get(row, "$.segments", "array<variant>"))

    def one(v: Column) -> Column:
        start = F.coalesce(F.try_variant_get(v, "$.start", "double"), F.lit(0.0))
        end = F.coalesce(F.try_variant_get(v, "$.end", "double"), start + F.coalesce(F.try_variant_get(v, "$.duration", "double"), F.lit(0.0)))
        text = F.try_variant_get(v, "$.text", "string")
        plain = F.schema_of_variant(v) == "STRING"
        return F.struct(F.when(plain, F.try_variant_get(v, "$", "string")).otherwise(F.coalesce(text, F.lit(""))).alias("text"), F.when(plain, 0.0).otherwise(start).alias("start"), F.when(plain, 0.0).otherwise(end).alias("end"))

    return F.coalesce(F.transform(rows, one), F.array().cast(SEGMENTS))


def comments_of(row: str = "row") -> Column:
    def one(v: Column) -> Column:
        plain = F.schema_of_variant(v) == "STRING"
        text = F.when(plain, F.try_variant_get(v, "$", "string")).otherwise(F.coalesce(F.try_variant_get(v, "$.text", "string"), F.lit("")))
        return F.struct(text.alias("text"), F.coalesce(F.try_variant_get(v, "$.author", "string"), F.lit("")).alias("author"), F.coalesce(F.try_variant_get(v, "$.likes", "int"), F.lit(0)).alias("likes"), F.coalesce(F.try_variant_get(v, "$.replies", "array<string>"), F.array().cast("array<string>")).alias("replies"))

    return F.coalesce(F.transform(F.try_variant_get(row, "$.comments", "array<variant>"), one), F.array().cast(COMMENTS))


def as_items(rows: DataFrame, name: str = "local", stem: str = "", now: float = 0.0) -> DataFrame:
    """Saved items from what a reader gives. A row without an id of its URL takes its own id, else name-idx; a missing title
    names its place, a missing folder the file (or stem, where given), a missing time is now.

    idx counts in each file. Where there are several files, name-idx would name different things alike, so the file's name is part of it."""
    who = identify(canonical_url(pick("url")))
    several = rows.select("scan.path").distinct().limit(2).count() > 1
    known = rows.select("file", "idx", "scan", "row", who.alias("w"))
    or_else = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), other)
    source = or_else(F.col("w.source"), F.lit(name))
    own = F.concat_ws("-", F.lit(name), *(["file"] if several else []), F.col("idx").cast("string"))
    source_id = or_else(F.col("w.source_id"), or_else(get("id"), own))
    kind = or_else(get("media_kind"), F.when(F.col("w.source") == "", "video").otherwise(F.col("w.media_kind")))
    saved = F.coalesce(F.nullif(get("saved_at", "double"), F.lit(0.0)), F.lit(now))
    return known.select(
        F.concat_ws(":", source, source_id).alias("id"), source.alias("source"), source_id.alias("source_id"), kind.alias("media_kind"),
        or_else(pick("title"), F.concat(F.lit("Item "), (F.col("idx") + 1).cast("string"))).alias("title"), pick("url").alias("url"), pick("author").alias("author"),
        pick("description").alias("description"), pick("thumbnail").alias("thumbnail"), or_else(pick("folder"), F.lit(stem) if stem else F.col("file")).alias("folder"),
        F.coalesce(get("duration", "double").cast("int"), F.lit(0)).alias("duration"), saved.alias("saved_at"),
        F.coalesce(F.filter(get("tags", "array<string>"), lambda t: t.isNotNull() & (t != "")), F.array().cast("array<string>")).alias("tags"),
        segments_of().alias("segments"), comments_of().alias("comments"), F.col("scan").alias("idx"),
    )


def first_of_each(items: DataFrame, order: str = "idx") -> DataFrame:
    """One row for each id, the first scanned (a thing saved in two folders)."""
    w = W.partitionBy("id").orderBy(order)
    return items.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def iso_seconds(text: Column) -> Column:
    """Seconds of an ISO 8601 duration, 0 if it isn't one."""
    whole = r"^P(?:(\d+)D)?T?(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?$"
    part = lambda k: F.coalesce(F.try_cast(F.regexp_extract(F.trim(text), whole, k), "long") if hasattr(F, "try_cast") else F.regexp_extract(F.trim(text), whole, k).try_cast("long"), F.lit(0))
    return part(1) * 86400 + part(2) * 3600 + part(3) * 60 + part(4)


def rfc3339_seconds(text: Column) -> Column:
    """Epoch seconds of the wall time, the offset being taken for UTC; 0 if unreadable."""
    local = F.regexp_replace(F.replace(F.trim(text), F.lit("T"), F.lit(" ")), r"(?:Z|[+-]\d\d:?\d\d)$", "")
    at = F.concat(local, F.lit("+00:00")).try_cast("timestamp")
    return F.coalesce(F.unix_micros(at) / 1e6, F.lit(0.0))


def caption_segments(payload: Column) -> Column:
    """Segments of a json3 caption payload (events of tStartMs, dDurationMs, segs), blank ones left out."""
    doc = F.from_json(payload, "events array<struct<tStartMs:double,dDurationMs:double,segs:array<struct<utf8:string>>>>")
    each = F.transform(doc["events"], lambda e: F.struct(F.regexp_replace(F.concat_ws("", F.transform(e["segs"], lambda s: s["utf8"])), r"(?U)^\s+|\s+$", "").alias("text"), (F.coalesce(e["tStartMs"], F.lit(0.0)) / 1000).alias("start"), ((F.coalesce(e["tStartMs"], F.lit(0.0)) + F.coalesce(e["dDurationMs"], F.lit(0.0))) / 1000).alias("end")))
    return F.coalesce(F.filter(each, lambda s: s["text"] != ""), F.array().cast(SEGMENTS))


def subtitle_segments(payload: Column) -> Column:
    """Segments of a subtitle payload (body of from, to, content)."""
    doc = F.from_json(payload, "body array<struct<`from`:double,`to`:double,content:string>>")
    each = F.transform(doc["body"], lambda e: F.struct(F.trim(F.coalesce(e["content"], F.lit(""))).alias("text"), F.coalesce(e["from"], F.lit(0.0)).alias("start"), F.coalesce(e["to"], F.lit(0.0)).alias("end")))
    return F.coalesce(F.filter(each, lambda s: s["text"] != ""), F.array().cast(SEGMENTS))


def best_track(tracks: Column, languages: list[str]) -> Column:
    """Of array<struct<language, generated, url>> the first by language preference, written before generated."""
    rank = lambda t: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, languages)), t["language"]), F.lit(0)), F.lit(len(languages) + 1))
    keyed = F.transform(tracks, lambda t, i: F.struct(rank(t).alias("r"), t["generated"].alias("g"), i.alias("i"), t["url"].alias("url")))
    return F.array_min(keyed)["url"]
