"""The library's tables: merges that keep what users own, lifecycle marks, queues, listings and metrics.

Tables are values: each function gives the new table, which the caller writes as a new version. User-owned columns are
status, user_tags, note and status_at; ingest never changes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

USER_COLUMNS = ("status", "user_tags", "note", "status_at")
STATUSES = ("active", "digested", "muted")


def ingest_diff(incoming: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """incoming (id, content_hash, ...) with state: added, updated or skipped. stored: id, content_hash."""
    known = stored.select("id", F.col("content_hash").alias("known"))
    same = F.col("known") == F.col("content_hash")
    state = F.when(F.col("known").isNull(), "added").when(same & F.lit(not force), "skipped").otherwise("updated")
    return incoming.join(known, "id", "left").withColumn("state", state).drop("known")


def ingest_report(outcomes: DataFrame) -> DataFrame:
    """Counters by source from outcome rows (source, state, has_transcript, n_comments, chunks)."""
    n = lambda c: F.count_if(c)
    done = F.col("state").isin("added", "updated")
    return outcomes.groupBy("source").agg(
        F.count("*").alias("seen"), *[n(F.col("state") == s).alias(s) for s in ("added", "updated", "skipped", "failed")],
        n(done & F.col("has_transcript")).alias("with_transcript"), n(done & (F.col("n_comments") > 0)).alias("with_comments"), F.coalesce(F.sum(F.when(done, F.col("chunks"))), F.lit(0)).alias("chunks"),
    )


def upsert_items(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """stored merged with incoming by id: platform columns from incoming where it has the id, user columns from stored."""
    new = incoming.select("id", *[F.col(c).alias(f"_{c}") for c in incoming.columns if c != "id" and c not in USER_COLUMNS], F.lit(True).alias("_here"))
    both = stored.withColumn("_old", F.lit(True)).join(new, "id", "full")
    start = {"status": F.lit("active"), "user_tags": F.array().cast("array<string>"), "note": F.lit(""), "status_at": F.lit(0.0)}
    cols = []
    for c in stored.columns:
        if c == "id":
            cols.append(F.col("id"))
        elif c in USER_COLUMNS:
            cols.append(F.when(F.col("_old"), F.col(c)).otherwise(start[c]).alias(c))
        elif f"_{c}" in new.columns:
            cols.append(F.when(F.col("_here"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return both.select(*cols)


def replace_chunks(chunks: DataFrame, items: DataFrame, new: DataFrame) -> DataFrame:
    """All passages of items (id) give way to new ones."""
    return chunks.join(items.select(F.col("id").alias("item_id")).distinct(), "item_id", "left_anti").unionByName(new)


def delete_items(items: DataFrame, chunks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    ids = gone.select("id").distinct()
    return items.join(ids, "id", "left_anti"), chunks.join(ids.withColumnRenamed("id", "item_id"), "item_id", "left_anti")


def mark(items: DataFrame, marks: DataFrame) -> DataFrame:
    """items with marks (id, status, add_tags, remove_tags, note, at) applied, one for each id; nulls leave a column as it is.

    Added tags are trimmed and keep the order of their first appearance. Marks of unknown items do nothing; a status
    that is not one of STATUSES raises."""
    m = marks.select("id", *[F.col(c).alias(f"m_{c}") for c in ("status", "add_tags", "remove_tags", "note", "at")], F.lit(True).alias("m"))
    none = F.array().cast("array<string>")
    tags = F.array_union(F.col("user_tags"), F.filter(F.transform(F.coalesce("m_add_tags", none), lambda t: F.trim(t)), lambda t: t != ""))
    tags = F.filter(tags, lambda t: ~F.array_contains(F.coalesce("m_remove_tags", none), t))
    status = F.when(F.col("m_status").isNull(), F.col("status")).when(F.col("m_status").isin(*STATUSES), F.col("m_status")).otherwise(F.raise_error(F.concat(F.lit("unknown status "), F.col("m_status"))).cast("string"))
    new = {"status": status, "user_tags": F.when(F.col("m"), tags).otherwise(F.col("user_tags")), "note": F.coalesce("m_note", "note"), "status_at": F.when(F.col("m"), F.col("m_at")).otherwise(F.col("status_at"))}
    return items.join(m, "id", "left").select(*[new.get(c, F.col(c)).alias(c) for c in items.columns])


def silenced(items: DataFrame, digested: bool = True) -> DataFrame:
    """Ids of items that must not come up unasked."""
    return items.where(F.col("status").isin(*(["muted", "digested"] if digested else ["muted"]))).select("id")


#: Where a listing's query is sought.
SEARCHED = ("title", "author", "description")


def meeting(items: DataFrame, source: str = "", query: str = "", status: str = "", tag: str = "", media_kind: str = "") -> DataFrame:
    """Items that meet every given filter. The tag must match exactly; query is sought in title, author and description without regard to case."""
    for c, v in (("source", source), ("status", status), ("media_kind", media_kind)):
        if v:
            items = items.where(F.col(c) == v)
    if tag:
        items = items.where(F.array_contains("user_tags", tag))
    if query:
        found = F.lit(False)
        for c in SEARCHED:
            found = found | F.contains(F.lower(F.col(c)), F.lit(query.lower()))
        items = items.where(found)
    return items


def list_items(items: DataFrame, source: str = "", query: str = "", status: str = "", tag: str = "", media_kind: str = "", limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of items that meet every given filter (see meeting()), the latest saved first. A Listing (listing.py) gives the same without reading them all."""
    return meeting(items, source, query, status, tag, media_kind).orderBy(F.desc("saved_at"), F.desc("indexed_at"), "id").offset(offset).limit(limit)


def tag_cloud(items: DataFrame) -> DataFrame:
    return items.select(F.explode("user_tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag")


def library_stats(items: DataFrame, chunks: DataFrame, events: DataFrame) -> DataFrame:
    """One row of totals. coverage: digested of all; fire_rate: items fired of all."""
    a = items.agg(F.count("*").alias("items"), F.count_if("has_transcript").alias("items_with_transcript"), F.count_if(F.col("status") == "digested").alias("items_digested"), F.count_if(F.col("transcript_source") == "whisper").alias("items_transcribed"), F.coalesce(F.max("indexed_at"), F.lit(0.0)).alias("last_indexed_at"))
    b = chunks.agg(F.count("*").alias("chunks"), F.count_if(F.col("kind") == "comment").alias("comment_chunks"))
    # distinct before counting: a hot item is folded in the map tasks
    c = events.where("kind = 'fired'").select("item_id").distinct().agg(F.count("*").alias("items_fired"))
    return with_rates(a.crossJoin(b).crossJoin(c))


def with_rates(totals: DataFrame) -> DataFrame:
    share = lambda x: F.coalesce(F.round(F.try_divide(F.col(x), F.col("items")), 4), F.lit(0.0))
    return totals.withColumn("coverage", share("items_digested")).withColumn("fire_rate", share("items_fired"))


def counts_by(items: DataFrame, *columns: str) -> DataFrame:
    """(facet, value, n) for each column, in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])
    return items.select(F.explode(pairs).alias("x")).groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def hydration_queue(items: DataFrame, limit: int = 200) -> DataFrame:
    """The links whose pages are still to be read, the oldest first."""
    return items.where("transcript_source = 'pending'").orderBy("saved_at", "id").limit(limit)


def hydrated(items: DataFrame, read: DataFrame) -> DataFrame:
    """items after reading (id, title, author, ok): those read leave the queue as capture, unreadable ones as none."""
    r = read.select("id", F.col("title").alias("r_title"), F.col("author").alias("r_author"), "ok")
    both = items.join(r, "id", "left")
    title = F.when(F.col("ok") & (F.col("r_title") != "") & ((F.col("title") == "") | (F.col("title") == F.col("url"))), F.substring("r_title", 1, 300)).otherwise(F.col("title"))
    author = F.when(F.col("ok") & (F.col("r_author") != "") & (F.col("author") == ""), F.substring("r_author", 1, 120)).otherwise(F.col("author"))
    new = {"title": title, "author": author, "transcript_source": F.when(F.col("ok"), "capture").when(~F.col("ok"), "none").otherwise(F.col("transcript_source"))}
    return both.select(*[new.get(c, F.col(c)).alias(c) for c in items.columns])


def recent_events(events: DataFrame, limit: int = 50) -> DataFrame:
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(limit)


def captured(url: Column, title: Column, author: Column, excerpt: Column, folder: Column, tags: Column) -> list[Column]:
    """The columns of a captured page, cut to size: title falls back to the URL."""
    cut = lambda c, n: F.substring(F.coalesce(c, F.lit("")), 1, n)
    kept = F.slice(F.transform(F.filter(tags, lambda t: t.isNotNull() & (t != "")), lambda t: F.substring(t, 1, 40)), 1, 20)
    return [F.substring(F.coalesce(F.nullif(title, F.lit("")), url), 1, 300).alias("title"), cut(author, 120).alias("author"), cut(excerpt, 4000).alias("description"), cut(folder, 120).alias("folder"), F.coalesce(kept, F.array().cast("array<string>")).alias("tags")]


def capture_summary(outcomes: DataFrame, errors: int = 20) -> DataFrame:
    """One row of counts from (state, needs_body, error, seq) and the first errors; a duplicate that was skipped still needs its body."""
    states = outcomes.agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("added", "updated", "skipped", "failed")], F.count_if((F.col("state") != "failed") & F.col("needs_body")).alias("needs_body"))
    first = outcomes.where("state = 'failed'").orderBy("seq").limit(errors).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.substring("error", 1, 200).alias("e")))), lambda x: x["e"]).alias("errors"))
    return states.crossJoin(first)


def lookup(items: DataFrame, ids: DataFrame) -> DataFrame:
    """The items that ids (id) names, each once."""
    return items.join(ids.select("id").distinct(), "id", "left_semi")


def stale_vectors(chunks: DataFrame, vectors: DataFrame, signature: str) -> DataFrame:
    """Passages whose vector is missing or of another embedder; vectors: chunk_id, embedder."""
    good = vectors.where(F.col("embedder") == signature).select("chunk_id").distinct()
    return chunks.join(good, "chunk_id", "left_anti")


def vector_coverage(chunks: DataFrame, vectors: DataFrame, signature: str) -> DataFrame:
    """One row: passages, comparable ones among them, and their share."""
    good = vectors.where(F.col("embedder") == signature).select("chunk_id", F.lit(1).alias("good")).distinct()
    out = chunks.join(good, "chunk_id", "left").agg(F.count("*").alias("chunks"), F.count("good").alias("comparable"))
    return out.withColumn("share", F.coalesce(F.round(F.try_divide("comparable", "chunks"), 4), F.lit(0.0)))


def upsert_meta(meta: DataFrame, new: DataFrame) -> DataFrame:
    """(key, value) pairs with new ones put in."""
    return meta.join(new.select("key").distinct(), "key", "left_anti").unionByName(new)


def clamp(value: int, least: int, most: int) -> int:
    """A limit that a caller asks for, brought into bounds."""
    return max(least, min(most, int(value)))


#: Limits that callers may ask for: searches, listings, event logs.
BOUNDS = {"search": (1, 50), "items": (1, 200), "events": (1, 500)}
