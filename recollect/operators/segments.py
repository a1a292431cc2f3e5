"""An inverted index that changes: immutable segments, tombstones for what later ones replace, and a manifest that says which of them count.

A segment holds what one change brought: blocks of postings, document frequencies, what a search has to know of a passage, packed vectors,
and the ids of the passages that left the index. Frequencies are signed, so that those of all segments add up to the index's own, whatever
has left; passages that have left are taken out where postings and vectors are read. Segments of like size are merged, so that their
number grows with the logarithm of the changes, and what a merge has taken out is gone for good."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from .index import PACK, Index, described, name_tokens, packed
from .manifest import Manifest
from .shared import groups, let_go, moved

#: Passages of one zone: postings of a token in a zone make a block.
ZONE_BITS = 7
#: Passages from which on a block is dealt apart from others of its token.
DENSE = 8
#: Tokens that blocks are formed of in one go; more where one zone has more.
AT_ONCE = 400_000
#: Segments of one tier that are merged into one; tiers grow by this factor.
FAN = 4
#: Of all passages written, the share that may have left before everything is merged.
MOST_DEAD = 0.3
#: Passages, or tokens, that a task should take at least.
ROWS, TOKENS = 20_000, 200_000
TOMBS = "chunk_id {kind}"


@dataclass(frozen=True)
class Segment:
    """seq orders segments: tombstones of one hold for those before it. n and length (passages, tokens in them) are net of what it took out; rows
    were written, packs is the number of packs of vectors, dead of tombstones."""

    seq: int
    path: str
    n: int
    length: int
    rows: int
    packs: int
    dead: int


def keep(df: DataFrame, path: str) -> None:
    """Small pages, so that a filter reads little besides what it asks for."""
    df.write.option("compression", "zstd").option("parquet.page.size", "65536").option("parquet.block.size", str(32 << 20)).parquet(path)


def blocks_of(chunks: DataFrame, parts: int) -> DataFrame:
    """(token, zone, max_tf, min_len, n, posts: array<struct<chunk_id, tf, doc_len>>) of tokenised passages, sorted by token and zone.

    A zone is 128 passages that follow each other by chunk_id, so that passages of one item share zones (their order is fixed before they are numbered,
    so that tasks that run again number them alike). A zone lies in one task, which forms its blocks: what is shuffled are blocks, not tokens. They are
    dealt by token, those that hold DENSE passages or more by zone too: a token of any number of passages parts among files, one of few is in one. No
    ranges are sampled for that, which would form all blocks twice."""
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    zoned = chunks.select("chunk_id", "doc_len", "tokens").repartitionByRange(parts, "chunk_id").sortWithinPartitions("chunk_id").withColumn("zone", F.shiftright(F.monotonically_increasing_id(), ZONE_BITS))
    schema = f"token string, zone long, max_tf int, min_len int, n int, posts array<struct<chunk_id:{kind},tf:int,doc_len:int>>"
    return dealt(zoned.mapInArrow(zone_blocks, schema), parts)


def dealt(blocks: DataFrame, parts: int) -> DataFrame:
    """Blocks by token, those of DENSE passages or more by zone too, sorted in each part."""
    place = F.pmod(F.xxhash64("token", F.when(F.col("n") >= DENSE, F.col("zone")).otherwise(F.lit(-1))), F.lit(parts)).cast("int")
    rows = moved(blocks.withColumn("_to", place), "_to", lambda b: b.repartitionById(parts, F.col("key")))
    return rows.drop("_to").sortWithinPartitions("token", "zone")


def without(blocks: DataFrame, gone: DataFrame) -> DataFrame:
    """Blocks (token, zone, seq, max_tf, min_len, n, posts) without the postings of passages that have left (chunk_id, gone), where they lie: tasks get the ids
    of those, sorted. For no more of them than broadcast_numbers."""
    import numpy as np
    import pyarrow as pa

    left = gone.toArrow()
    order = np.argsort(ids := left.column("chunk_id").to_numpy().astype("U" if pa.types.is_string(left.schema.field("chunk_id").type) else np.int64))
    held = blocks.sparkSession.sparkContext.broadcast((ids[order], left.column("gone").to_numpy()[order]))

    def run(batches):
        import pyarrow.compute as pc

        ids, since = held.value
        for b in batches:
            names = b.schema.names
            posts = b.column(names.index("posts"))
            flat, parent = pc.list_flatten(posts), pc.list_parent_indices(posts).to_numpy()
            if not len(flat):
                continue
            own = flat.field("chunk_id").dictionary_encode()
            each = np.array(own.dictionary.to_pylist())
            at = np.minimum(np.searchsorted(ids, each), len(ids) - 1)
            until = np.where(ids[at] == each, since[at], -1)[own.indices.to_numpy()]
            stay = until <= b.column(names.index("seq")).to_numpy()[parent]
            flat, parent = flat.filter(pa.array(stay)), parent[stay]
            start = np.flatnonzero(np.append(True, np.diff(parent) != 0)) if len(parent) else np.empty(0, np.int64)
            if not len(start):
                continue
            tf, length = (flat.field(c).to_numpy() for c in ("tf", "doc_len"))
            rest = b.take(pa.array(parent[start]))
            new = {"max_tf": pa.array(np.maximum.reduceat(tf, start)), "min_len": pa.array(np.minimum.reduceat(length, start)), "n": pa.array(np.diff(np.append(start, len(parent))).astype(np.int32)), "posts": pa.ListArray.from_arrays(pa.array(np.append(start, len(parent)).astype(np.int32)), flat)}
            yield pa.RecordBatch.from_arrays([new.get(c, rest.column(i)) for i, c in enumerate(names)], names=names)

    return blocks.mapInArrow(run, blocks.schema)


def zone_blocks(batches):
    """The blocks of passages (chunk_id, doc_len, tokens, zone) that come sorted by zone; those of several zones in one go."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def pieces(b):
        """Whole zones, of about AT_ONCE tokens together, so that a task's memory depends on no batch size."""
        zone, total, start = b.column(3).to_numpy(), np.cumsum(pc.fill_null(pc.list_value_length(b.column(2)), 0).to_numpy(zero_copy_only=False)), 0
        for end in [*(np.flatnonzero(np.diff(zone)) + 1).tolist(), b.num_rows]:
            if end == b.num_rows or total[end - 1] - (total[start - 1] if start else 0) >= AT_ONCE:
                yield b.slice(start, end - start)
                start = end

    for b in (piece for t in groups(batches, ["zone"]) for piece in pieces(t.to_batches()[0])):
        ids, doc_len, zone = b.column(0), b.column(1).to_numpy(zero_copy_only=False), b.column(3).to_numpy()
        # rows of one id count as one passage
        codes = ids.dictionary_encode().indices.to_numpy()
        first = np.unique(codes, return_index=True)[1][codes]
        row = first[pc.list_parent_indices(b.column(2)).to_numpy()]
        words = pc.list_flatten(b.column(2)).dictionary_encode()
        if not len(row):
            continue
        v = max(1, len(words.dictionary))
        each, tf = np.unique(row.astype(np.int64) * v + words.indices.to_numpy(), return_counts=True)
        row, word = np.divmod(each, v)
        numbered = np.searchsorted(np.unique(zone), zone)
        key = numbered[row] * v + word
        order = np.argsort(key, kind="stable")
        key, row, word, tf = key[order], row[order], word[order], tf[order].astype(np.int32)
        start = np.flatnonzero(np.append(True, np.diff(key) != 0))
        length = doc_len[row].astype(np.int32)
        posts = pa.StructArray.from_arrays([ids.take(pa.array(row)), pa.array(tf), pa.array(length)], names=["chunk_id", "tf", "doc_len"])
        cols = [
            words.dictionary.take(pa.array(word[start])), pa.array(zone[row[start]]), pa.array(np.maximum.reduceat(tf, start)), pa.array(np.minimum.reduceat(length, start)),
            pa.array(np.diff(np.append(start, len(key))).astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.append(start, len(key)).astype(np.int32)), posts),
        ]
        out = pa.RecordBatch.from_arrays(cols, names=["token", "zone", "max_tf", "min_len", "n", "posts"])
        for i in range(0, out.num_rows, 10_000):
            yield out.slice(i, 10_000)


def tasks(spark: SparkSession, rows: int, tokens: int) -> int:
    return max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(-(-rows // ROWS), -(-tokens // TOKENS))))


def write_segment(spark: SparkSession, root: str, seq: int, chunks: DataFrame, vectors: DataFrame | None = None, removed: DataFrame | None = None) -> Segment:
    """Write what a change brings: tokenised passages and their vectors, and the tokenised passages (chunk_id, tokens, doc_len) that leave the
    index. A passage that is replaced is in both. Its cost is that of the change, whatever the index holds."""
    path = f"segments/{seq:012d}-{uuid.uuid4().hex}"
    of = lambda df: df.agg(F.count("*"), F.coalesce(F.sum("doc_len"), F.lit(0))).first()
    rows, length = of(chunks)
    dead, less = of(removed) if removed is not None else (0, 0)
    parts = tasks(spark, rows, length)
    blocks = blocks_of(chunks, parts)
    keep(blocks, f"{root}/{path}/blocks")
    if parts > 1:  # what was shuffled is of no more use
        let_go(spark)
    counts = spark.read.parquet(f"{root}/{path}/blocks").select("token", F.col("n").cast("long").alias("df"))
    if dead:
        counts = counts.unionByName(removed.select(F.explode(F.array_distinct("tokens")).alias("token"), F.lit(-1).cast("long").alias("df")))
    counts = counts.groupBy("token").agg(F.sum("df").alias("df")).where("df <> 0")
    keep(counts.repartitionByRange(max(1, parts // 4), "token").sortWithinPartitions("token"), f"{root}/{path}/terms")
    keep(described(chunks).repartition(parts, "chunk_id").sortWithinPartitions("chunk_id"), f"{root}/{path}/chunks")
    packs = 0
    if vectors is not None:
        packs = max(1, -(-rows // PACK))
        numbered = vectors.select("chunk_id", "idx", "val", F.pmod(F.xxhash64("chunk_id"), F.lit(packs)).cast("int").alias("pack"))
        keep(packed(numbered.repartition(min(parts, packs), "pack").sortWithinPartitions("pack", "chunk_id")), f"{root}/{path}/packs")
    if dead:
        keep(removed.select("chunk_id").coalesce(max(1, -(-dead // (50 * ROWS)))), f"{root}/{path}/dead")
    return Segment(seq, path, rows - dead, length - less, rows, packs, dead)


def tombstones(spark: SparkSession, root: str, segments: list[Segment]) -> DataFrame | None:
    """(chunk_id, gone): passages that left all segments before gone; None where none has left."""
    out = None
    for s in segments:
        if s.dead:
            one = spark.read.parquet(f"{root}/{s.path}/dead").select("chunk_id", F.lit(s.seq).cast("long").alias("gone"))
            out = one if out is None else out.unionByName(one)
    return None if out is None else out.groupBy("chunk_id").agg(F.max("gone").alias("gone"))


def living(rows: DataFrame, dead: DataFrame | None) -> DataFrame:
    """rows (seq, chunk_id, ...) of passages that are in the index still."""
    if dead is None:
        return rows
    d = dead.withColumnRenamed("chunk_id", "_c")
    return rows.join(d, (F.col("chunk_id") == F.col("_c")) & (F.col("seq") < F.col("gone")), "left_anti")


def union(spark: SparkSession, root: str, segments: list[Segment], table: str) -> DataFrame:
    out = None
    for s in segments:
        one = spark.read.parquet(f"{root}/{s.path}/{table}").withColumn("seq", F.lit(s.seq).cast("long"))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def read_index(spark: SparkSession, root: str, segments: list[Segment], cfg: Settings = Settings()) -> Index:
    """The index that segments make up."""
    name_tokens(spark)
    if not segments:
        raise ValueError("an index without segments")
    n, length = sum(s.n for s in segments), sum(s.length for s in segments)
    dead = tombstones(spark, root, segments)
    blocks = union(spark, root, segments, "blocks")
    terms = union(spark, root, segments, "terms").drop("seq")
    if len(segments) > 1:
        terms = terms.groupBy("token").agg(F.sum("df").alias("df")).where("df > 0")
    chunks = living(union(spark, root, segments, "chunks"), dead).drop("seq")
    packs = None
    for s in segments:
        if s.packs:
            one = spark.read.parquet(f"{root}/{s.path}/packs")
            if dead is not None:
                gone = dead.where(F.col("gone") > s.seq).groupBy(F.pmod(F.xxhash64("chunk_id"), F.lit(s.packs)).cast("int").alias("pack")).agg(F.collect_list("chunk_id").alias("dead"))
                one = one.join(gone, "pack", "left")
            packs = one if packs is None else packs.unionByName(one)
    none = spark.createDataFrame([], f"ids array<{blocks.schema['posts'].dataType.elementType['chunk_id'].dataType.simpleString()}>, n array<int>, idx array<int>, val array<double>")
    avg = length / n if n else 1.0
    return Index(exploded(blocks, dead), terms, chunks, none if packs is None else packs, n, avg or 1.0, max(8, int(n * cfg.max_df_ratio)), blocks, dead)


def exploded(blocks: DataFrame, dead: DataFrame | None) -> DataFrame:
    """The postings (token, chunk_id, tf, doc_len) of blocks."""
    rows = blocks.select("token", "seq", F.inline("posts"))
    return living(rows, dead).select("token", "chunk_id", "tf", "doc_len")


def tier(s: Segment) -> int:
    """The power of FAN that its rows and tombstones reach, counted in thousands."""
    size, t = max(s.rows, s.dead) // 1000, 0
    while size:
        size, t = size // FAN, t + 1
    return t


def due(segments: list[Segment]) -> tuple[int, int] | None:
    """From and to (exclusive) of the segments that should be merged now: all, where too much is dead; else the newest ones, back to a
    larger one, where FAN of them are of one tier and none is above it."""
    rows, gone = sum(s.rows for s in segments), sum(s.dead for s in segments)
    if gone > MOST_DEAD * rows and len(segments) > 1:
        return 0, len(segments)
    for t in sorted({tier(s) for s in segments}):
        end = len(segments)
        start = end
        while start and tier(segments[start - 1]) <= t:
            start -= 1
        if sum(tier(s) == t for s in segments[start:]) >= FAN:
            return start, end
    return None


def merged(spark: SparkSession, root: str, segments: list[Segment], start: int, end: int) -> Segment:
    """segments[start:end] as one, without what has left; its tombstones stay while there are segments before it that they hold for."""
    own, dead = segments[start:end], tombstones(spark, root, segments)
    path = f"segments/{own[-1].seq:012d}-{uuid.uuid4().hex}"
    at, parts = f"{root}/{path}", tasks(spark, sum(s.rows for s in own), sum(abs(s.length) for s in own))
    # zones keep their passages, but get numbers of their own (two that met by chance would have a bound that is too high, which loses nothing)
    alive = union(spark, root, own, "blocks").withColumn("zone", F.xxhash64("seq", "zone"))
    if dead is not None and sum(s.dead for s in segments) <= Settings().broadcast_numbers:
        alive = without(alive, dead)
    elif dead is not None:
        rows = living(alive.select("token", "zone", "seq", F.inline("posts")), dead)
        alive = rows.groupBy("token", "zone").agg(F.max("tf").alias("max_tf"), F.min("doc_len").alias("min_len"), F.count("*").cast("int").alias("n"), F.collect_list(F.struct("chunk_id", "tf", "doc_len")).alias("posts"))
    keep(dealt(alive.drop("seq"), parts), f"{at}/blocks")
    let_go(spark)
    terms = union(spark, root, own, "terms").groupBy("token").agg(F.sum("df").alias("df")).where("df <> 0")
    keep(terms.repartitionByRange(max(1, parts // 4), "token").sortWithinPartitions("token"), f"{at}/terms")
    keep(living(union(spark, root, own, "chunks"), dead).drop("seq").repartitionByRange(parts, "chunk_id").sortWithinPartitions("chunk_id"), f"{at}/chunks")
    rows = spark.read.parquet(f"{at}/chunks").count()
    packs = 0
    if any(s.packs for s in own):
        packs = max(1, -(-rows // PACK))
        vectors = living(union(spark, root, [s for s in own if s.packs], "packs").mapInArrow(unpack, f"chunk_id {described_kind(spark, at)}, seq long, idx array<int>, val array<double>"), dead)
        numbered = vectors.select("chunk_id", "idx", "val", F.pmod(F.xxhash64("chunk_id"), F.lit(packs)).cast("int").alias("pack"))
        keep(packed(numbered.repartition(min(parts, packs), "pack").sortWithinPartitions("pack", "chunk_id")), f"{at}/packs")
    gone = 0
    if start and any(s.dead for s in own):
        held = tombstones(spark, root, own).select("chunk_id")
        keep(held.coalesce(1), f"{at}/dead")
        gone = spark.read.parquet(f"{at}/dead").count()
    return Segment(own[-1].seq, path, sum(s.n for s in own), sum(s.length for s in own), rows, packs, gone)


def described_kind(spark: SparkSession, at: str) -> str:
    return spark.read.parquet(f"{at}/chunks").schema["chunk_id"].dataType.simpleString()


def unpack(batches):
    """Packs (ids, n, idx, val, seq) as one row for each vector."""
    import numpy as np
    import pyarrow as pa

    for b in batches:
        names = b.schema.names
        for i in range(b.num_rows):
            ids, n, idx, val = (b.column(names.index(c))[i].values for c in ("ids", "n", "idx", "val"))
            ends = pa.array(np.append(0, np.cumsum(n.to_numpy())), pa.int32())
            seq = pa.array(np.full(len(ids), b.column(names.index("seq"))[i].as_py()), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, seq, pa.ListArray.from_arrays(ends, idx), pa.ListArray.from_arrays(ends, val)], names=["chunk_id", "seq", "idx", "val"])


def tidy(spark: SparkSession, root: str, segments: list[Segment]) -> tuple[list[Segment], list[str]]:
    """segments with all merges that are due, and the paths of those that they replace."""
    dead: list[str] = []
    while span := due(segments):
        start, end = span
        new = merged(spark, root, segments, start, end)
        dead += [s.path for s in segments[start:end]]
        segments = segments[:start] + [new] + segments[end:]
    return segments, dead


class Segmented:
    """An index of its own under root: change() adds and removes passages by one commit, index() reads the newest version."""

    def __init__(self, spark: SparkSession, root: str, cfg: Settings = Settings()):
        self.spark, self.root, self.cfg, self.manifest = spark, root, cfg, Manifest(spark, root)

    def segments(self) -> tuple[int, list[Segment]]:
        version, held = self.manifest.read()
        return version, [Segment(**s) for s in held.get("segments", [])]

    def change(self, chunks: DataFrame, vectors: DataFrame | None = None, removed: DataFrame | None = None) -> int:
        version, own = self.segments()
        new = write_segment(self.spark, self.root, max((s.seq for s in own), default=0) + 1, chunks, vectors, removed)
        own, dead = tidy(self.spark, self.root, [*own, new])
        return self.manifest.commit(version, {"segments": [vars(s) for s in own]}, dead)

    def index(self) -> Index:
        return read_index(self.spark, self.root, self.segments()[1], self.cfg)
