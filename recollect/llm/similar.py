"""Near copies on word shingles: SimHash links and MinHash bands bring candidates together, shingle sets decide exactly.

SimHash at 3 bits finds what differs in a few places. Texts that are 80 % alike may lie further apart than any distance at which unlike ones don't
crowd in, so bands of MinHash values, which agree with a probability that follows the likeness itself, find the rest: of pairs at 0.8
they miss one in 3,000, whatever the number of texts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import U64, groups, mix, raw, settle, small
from .components import components
from .simhash import CHUNK, fingerprint, links

#: Bytes of shingle sets of one bucket at most that one task compares with another such chunk.
CHUNK_BYTES = 32_000_000
#: A text has BANDS keys, each of ROWS MinHash values: a pair of likeness s shares one with probability 1 - (1 - s**ROWS)**BANDS.
BANDS, ROWS = 20, 5


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """The distinct XXH64 hashes of the word shingles, sorted; of a text of fewer words, that of all its words."""
    import xxhash

    words = text.lower().split()
    whole, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(whole, 43)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - shingle + 1
    return np.unique(np.fromiter((digest(whole[i:j], 43) for i, j in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64, n))


def bands(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys of a set: each mixes ROWS of its MinHash values with the band's number."""
    n = BANDS * ROWS
    up = mix(np.arange(1, n + 1, dtype=np.uint64)) | U64(1)
    add = mix(np.arange(n + 1, 2 * n + 1, dtype=np.uint64))
    low = np.full(n, np.iinfo(np.uint64).max)
    for k in range(0, len(hashes), 2048):
        x = hashes[None, k : k + 2048] * up[:, None]
        x += add[:, None]
        x ^= x >> U64(32)  # the low bits of a product know little of the high ones
        x *= U64(0xD6E8FEB86659FD93)
        np.minimum(low, x.min(axis=1), out=low)
    key = np.arange(BANDS, dtype=np.uint64)
    for column in low.reshape(BANDS, ROWS).T:
        key = mix(key ^ column) + U64(0x9E3779B97F4A7C15)
    return key


def alike(sets: list[np.ndarray], percent: int, group: np.ndarray | None = None):
    """Edges (from, to) that, with what is known to be of one group already, connect what pairs of sets with a Jaccard similarity of
    percent or more connect. The largest group is never searched from: whoever is like one of its sets is found from the other side."""
    group = np.arange(len(sets)) if group is None else np.unique(group, return_inverse=True)[1]
    sizes = np.array([len(s) for s in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    flags = np.zeros(ids.max() + 1, bool)
    members = np.bincount(group)
    rest = np.flatnonzero(group != np.argmax(members))
    for u in rest.tolist():
        other = group != group[u]
        if not other.any():
            return
        own = ids[starts[u] : starts[u] + sizes[u]]
        flags[own] = True
        common = np.add.reduceat(flags[ids], starts, dtype=np.int64)
        flags[own] = False
        near = np.flatnonzero(other & (100 * common >= percent * (sizes + sizes[u] - common)))
        for g, v in dict(zip(group[near].tolist(), near.tolist(), strict=True)).items():
            yield u, v
            group[group == g] = group[u]


def prints(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, text_hash, fp (of three-word shingles), node (a hash of the lower-case words), words and bands of every row."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        for b in small(batches):
            fp, node, n, keys = [], [], [], []
            for t in b.column(2).to_pylist():
                words = t.lower().split()
                fp.append(fingerprint(t, 3))
                node.append(xxhash.xxh3_64_intdigest(b" ".join(words)))
                n.append(len(words))
                keys.append(bands(shingle_set(t, shingle)).view(np.int64))
            hashes = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fp, node)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * BANDS, pa.int32()), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *hashes, pa.array(n, pa.int64()), lists], names=["doc_id", "text_hash", "fp", "node", "words", "bands"])

    return raw(docs).select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, fp long, node long, words long, bands array<long>")


def chosen_sets(docs: DataFrame, wanted: DataFrame, shingle: int, most_log2_bits: int = 27) -> DataFrame:
    """(key, set): shingle sets as bytes of the rows whose row_key() is in wanted.

    A Bloom filter of the keys goes to every task (past its limit it lets more rows through), so no other text is sent."""
    held, log2 = bloom.of(wanted.select("key"), most_log2_bits)
    sent = docs.sparkSession.sparkContext.broadcast(held)

    def run(batches):
        import pyarrow as pa

        bits = np.frombuffer(sent.value, np.uint8)
        for b in small(batches):
            at = np.flatnonzero(bloom.holds(bits, b.column(0).to_numpy().view(np.uint64), log2)).tolist()
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array([shingle_set(b.column(1)[i].as_py(), shingle).tobytes() for i in at], pa.binary())], names=["key", "set"])

    rows = raw(docs).select(row_key(F.col("doc_id"), F.xxhash64("text")).alias("key"), "text").mapInArrow(run, "key long, set binary")
    return rows.groupBy("key").agg(F.first("set").alias("set"))


def row_key(doc_id: Column, text_hash: Column) -> Column:
    """One number for a doc_id (also null) and a text."""
    return F.xxhash64(doc_id, text_hash)


def similar_rows(docs: DataFrame, **options) -> DataFrame:
    """doc_id, text_hash (XXH64 of the text, null: empty), n and first, for each distinct doc_id and text: n rows have them, and first
    is true if they are the first of their group of near copies (by doc_id, nulls last, then text_hash). options are those of similar_groups()."""
    rows = settle(prints(docs, options.get("shingle", 5)))
    low = settle(_grouped(docs, rows, **options))
    first = F.col("doc_id").eqNullSafe(F.col("low.doc_id")) & (F.col("text_hash") == F.col("low.text_hash"))
    # the groups are settled, so that Spark can split the rows of a text that is copied without end
    return rows.select("doc_id", "text_hash", "node").join(low.hint("merge"), "node").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"), F.max(first).alias("first"))


def similar_groups(docs: DataFrame, **options) -> DataFrame:
    """One row for each group of near copies: group, and doc_id and text_hash (XXH64 of the text, null: empty) of its first
    row by doc_id (nulls last), then text_hash. options: distance, shingle, percent, chunk.

    Texts of equal lower-case words fold into one node. Nodes whose SimHash fingerprints are within distance, or that share a band, are
    candidates; those whose sets of word shingles have a Jaccard similarity of percent or more are linked, and groups are what links connect.
    No candidate is left out: first each node is held against one of its candidates; a band's nodes that are of several groups then are compared with each
    other, all but those of one group. A band of more than chunk nodes, or more than CHUNK_BYTES of sets, is dealt out as pairs of chunks
    over many tasks."""
    return _grouped(docs, settle(prints(docs, options.get("shingle", 5))), **options).groupBy("group").agg(F.min("low").alias("low")).select("group", "low.doc_id", "low.text_hash")


def candidates(nodes: DataFrame, keyed: DataFrame, distance: int) -> DataFrame:
    """(a, b): one node that shares a band with it for each node that shares any, and the SimHash links."""
    firsts = settle(keyed.groupBy("band").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1").select("band", "b"))
    stars = keyed.join(firsts.hint("merge"), "band").where("node <> b").groupBy(F.col("node").alias("a")).agg(F.min("b").alias("b"))
    places = settle(nodes.groupBy("fp").agg(F.min("node").alias("b")))
    same = nodes.select("fp", F.col("node").alias("a")).join(places.hint("merge"), "fp").where("a <> b").select("a", "b")
    near = links(places.select("fp"), distance).withColumnsRenamed({"a": "x", "b": "y"})
    place = lambda c, name: places.select(F.col("fp").alias(c), F.col("b").alias(name)).hint("merge")
    near = near.join(place("x", "a"), "x").join(place("y", "b"), "y").select("a", "b")
    return stars.unionByName(same).unionByName(near).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose sets (node, set) are alike. Each pair takes in two sets, and nothing comes together by a node."""

    def run(batches):
        import pyarrow as pa

        for b in small(batches):
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True)) if percent * max(len(x), len(y)) <= 100 * min(len(x), len(y)) else 0
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    one = lambda c: sets.select(F.col("node").alias(c), F.col("set").alias(f"set_{c}")).hint("merge")
    return settle(pairs).join(one("a"), "a").join(one("b"), "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def left_over(keyed: DataFrame, roots: DataFrame, words: DataFrame, sets: DataFrame, percent: int, chunk: int) -> DataFrame:
    """Links (a, b) inside bands whose nodes are of several groups (roots: node, root) still. Bands of the same nodes count once."""
    placed = keyed.join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node")).join(words.hint("merge"), "node")
    sign = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s"), F.sum("words").alias("words"))
    bands_ = placed.groupBy("band").agg(sign.alias("sign"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    parts = F.greatest(F.ceil(F.col("sign.n") / chunk), F.ceil(F.col("sign.words") * 8 / CHUNK_BYTES)).cast("int")
    # kept apart from their aggregation, so that Spark can split a huge band's rows in the join
    open_ = settle(bands_.groupBy("sign").agg(F.min("band").alias("band")).select("band", parts.alias("parts")))
    met = placed.select("band", "node", "root").join(open_.hint("merge"), "band").withColumn("c", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    # chunk c meets every other chunk; alone, it meets itself
    met = met.withColumn("o", F.explode(F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: i != F.col("c")))))
    met = settle(met.select("band", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "node", "root"))
    keys = ["band", "i", "j"]

    def run(batches):
        import pyarrow as pa

        for table in groups(batches, keys):
            cols = [table.column(k).to_numpy() for k in keys]
            node, root = table.column("node").to_numpy(), table.column("root").to_numpy()
            new = np.zeros(len(node), bool)
            new[0] = True
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            at = np.append(np.flatnonzero(new), len(node))
            a, b = [], []
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if (root[lo:hi] != root[lo]).any():
                    for u, v in alike([np.frombuffer(s, np.uint64) for s in table.column("set").slice(lo, hi - lo).to_pylist()], percent, root[lo:hi]):
                        a.append(lo + u)
                        b.append(lo + v)
            yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

    return met.join(sets.hint("merge"), "node").select(*keys, "node", "root", "set").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def _grouped(docs: DataFrame, rows: DataFrame, distance: int = 3, shingle: int = 5, percent: int = 80, chunk: int = CHUNK) -> DataFrame:
    """(node, group, low): the group of each node, and the doc_id and text_hash of the group's first row. rows: prints(docs).

    All these tables grow with the documents, so their joins merge and nothing of them is broadcast from the driver."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("low")
    nodes = settle(rows.groupBy("node").agg(F.min("fp").alias("fp"), F.max("words").alias("words"), F.first("bands").alias("bands"), first))
    each = nodes.select("node", F.explode("bands").alias("band"))
    shared = settle(each.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band"))
    keyed = settle(each.join(shared.hint("merge"), "band"))
    pairs = settle(candidates(nodes, keyed, distance))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(keyed.select("node")).distinct()
    keys = settle(nodes.join(wanted.hint("merge"), "node").select("node", row_key(F.col("low.doc_id"), F.col("low.text_hash")).alias("key")))
    sets = settle(chosen_sets(docs, keys, shingle).join(keys.hint("merge"), "key").select("node", "set"))
    linked = settle(verified(pairs, sets, percent))
    more = left_over(keyed, components(linked), nodes.select("node", "words"), sets, percent, chunk)
    roots = components(linked.unionByName(more))
    grouped = settle(nodes.select("node", "low").join(roots.hint("merge"), "node", "left").select("node", "low", F.coalesce("root", "node").alias("group")))
    lows = grouped.groupBy("group").agg(F.min("low").alias("low"))
    return grouped.select("node", "group").join(lows.hint("merge"), "group").select("node", "group", "low")
