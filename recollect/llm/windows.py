"""Incremental substring dedup with a log-structured index of window fingerprints.

A window is a number of consecutive words. Its anchor is the least hash among the grams (shorter word runs) in it, so equal windows
have equal anchors at equal offsets. Neighbouring windows mostly share their anchor; those that do make a stretch, whose hash covers
all its words. The index holds one row for each distinct (anchor, stretch): two rows for 29 words instead of 29 window hashes.

Every batch becomes a sorted, immutable run, bucketed by the anchor. It is merge-joined with the historical runs, without
shuffling them. Equal stretches settle all their windows at once; where an anchor has several stretches, the hashes of their whole windows,
read again from one text of each, settle which windows repeat. What a batch shows to be repeated is written as marks, also for
windows of earlier batches. Runs are compacted by merging."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.manifest import Manifest
from . import bloom
from .common import SPACES, U64, checkpoint_dir, mix, raw, remove, settle, small

WINDOW, GRAM = 35, 8
GRAM_BASE, WINDOW_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
#: Bytes of a text that are hashed at a time.
BLOCK = 1 << 20
#: Rows that a task holds before it hands them on.
FLUSH = 400_000
RUN = "hash long, stretch long, n long, text_hash long"
MARKS = "hash long, stretch long, mask long"


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i below n."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        x = np.full(n, b, np.uint64)
        x[:1] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


class Anchors:
    """The stretches of one text, as arrays: anchor hash, place of the first window, number of windows, hash of the stretch."""

    def __init__(self, hash, offset, first, count, stretch, sums, down, window):
        self.hash, self.offset, self.first, self.count, self.stretch = hash, offset, first, count, stretch
        self._sums, self._down, self._window = sums, down, window

    def windows(self, at: np.ndarray):
        """Of the stretches at these places: (stretch number, number in the stretch, kind, hash of all words) of each window; windows
        of one kind have equal anchors at equal offsets."""
        row = np.repeat(at, self.count[at])
        k = np.arange(len(row)) - np.repeat(np.cumsum(self.count[at]) - self.count[at], self.count[at])
        i = self.first[row] + k
        own = mix((self._sums[i + self._window] - self._sums[i]) * self._down[i])
        kind = mix(self.hash[row] ^ mix((self.offset[row] - k).astype(np.uint64) + U64(1)))
        return row, k, kind, own


class Hasher:
    """Rolling hashes of word runs, vectorised over a document."""

    def __init__(self, window: int, gram: int):
        self.window, self.gram, self.size, self.bytes = window, gram, 0, 0
        self.spaces = np.zeros(256, bool)
        self.spaces[list(SPACES.encode())] = True
        self.letters = mix(np.arange(1, 257, dtype=np.uint64) * U64(WINDOW_BASE))

    def hashes(self, text: bytes) -> np.ndarray:
        """A 64-bit hash of each word: a polynomial in its bytes, from running sums over BLOCK bytes of whole words at a time. Words that
        are longer by themselves are hashed by themselves."""
        raw = np.frombuffer(text, np.uint8)
        blank = np.concatenate(([True], self.spaces[raw], [True]))
        edges = np.flatnonzero(blank[1:] != blank[:-1])
        starts, ends = edges[::2], edges[1::2]
        if self.bytes < BLOCK and self.bytes < len(raw):
            self.bytes = min(BLOCK, max(1 << 14, 2 * len(raw)))
            self.word_up, self.word_down = powers(WORD_BASE, self.bytes)
        out = np.empty(len(starts), np.uint64)
        at = 0
        while at < len(starts):
            first = int(starts[at])
            to = int(np.searchsorted(ends, first + BLOCK, "right"))
            if to == at:
                import xxhash

                out[at] = xxhash.xxh64_intdigest(text[first : ends[at]])
                at += 1
                continue
            part = raw[first : ends[to - 1]]
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.letters[part] * self.word_up[: len(part)], dtype=np.uint64)))
            begin = starts[at:to] - first
            out[at:to] = mix((sums[ends[at:to] - first] - sums[begin]) * self.word_down[begin])
            at = to
        return out

    def least(self, x: np.ndarray, width: int) -> np.ndarray:
        """For each run of that width the place of its least value, the first of equals: by runs of 1, 2, 4 ..."""
        n, at, size = len(x) - width + 1, np.arange(len(x)), 1
        while 2 * size <= width:
            right = x[size:] < x[:-size]
            at, x = np.where(right, at[size:], at[:-size]), np.minimum(x[:-size], x[size:])
            size *= 2
        rest = width - size
        return np.where(x[rest : rest + n] < x[:n], at[rest : rest + n], at[:n])

    def anchors(self, text: bytes) -> Anchors | None:
        """None if the text has no window."""
        if len(text) < 2 * self.window - 1:
            return None
        h = self.hashes(text)
        n = len(h)
        if n < self.window:
            return None
        if n > self.size:
            self.size = max(4096, 2 * n)
            self.pow = [powers(GRAM_BASE, self.size), powers(WINDOW_BASE, self.size)]
        zero = np.zeros(1, np.uint64)
        (up, down), (wide_up, wide_down) = self.pow
        sums = np.concatenate((zero, np.cumsum(h * up[:n], dtype=np.uint64)))
        grams = mix((sums[self.gram :] - sums[: -self.gram]) * down[: n - self.gram + 1])
        at = self.least(grams, self.window - self.gram + 1)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        count = np.diff(np.append(first, len(at)))
        offset = at[first] - first
        wide = np.concatenate((zero, np.cumsum(h * wide_up[:n], dtype=np.uint64)))
        whole = (wide[first + count + self.window - 1] - wide[first]) * wide_down[first]
        stretch = mix(mix(whole) ^ mix((offset.astype(np.uint64) << U64(32)) + count.astype(np.uint64)))
        return Anchors(grams[at[first]], offset, first, count, stretch, wide, wide_down, self.window)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (bytes), and two independent hashes of it."""
    return raw(docs).select("doc_id", F.xxhash64("text").alias("text_hash"), F.hash("text").alias("text_check"), "text")


def stretches(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(hash, stretch, n, text_hash): how often each stretch occurs, folded within each task, and a text that holds it."""

    def run(batches):
        import pyarrow as pa

        hasher = Hasher(window, gram)
        held, size = [], 0

        def flush():
            rows = np.concatenate(held)
            order = np.lexsort((rows["s"], rows["h"]))
            rows = rows[order]
            new = np.flatnonzero(np.concatenate(([True], (rows["h"][1:] != rows["h"][:-1]) | (rows["s"][1:] != rows["s"][:-1]))))
            n = np.diff(np.append(new, len(rows)))
            cols = (signed(np.ascontiguousarray(rows["h"][new])), signed(np.ascontiguousarray(rows["s"][new])), n.astype(np.int64), np.ascontiguousarray(rows["t"][new]))
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["hash", "stretch", "n", "text_hash"])

        for b in small(batches):
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if (got := hasher.anchors(text)) is not None:
                    rows = np.empty(len(got.hash), [("h", np.uint64), ("s", np.uint64), ("t", np.int64)])
                    rows["h"], rows["s"], rows["t"] = got.hash, got.stretch, key
                    held.append(rows)
                    size += len(rows)
                    if size > FLUSH:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    return keyed(docs).select("text_hash", "text").mapInArrow(run, RUN)


def joint(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One key from two 64-bit numbers, for filters."""
    return mix(a.view(np.uint64) + mix(b.view(np.uint64)))


def joined_keys(rows: DataFrame, *columns: str) -> DataFrame:
    """joint() of the columns, from left to right, as a column of its own."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            key = b.column(0).to_numpy().view(np.uint64)
            for c in b.columns[1:]:
                key = joint(key, c.to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(signed(key))], names=["key"])

    return rows.select(*columns).mapInArrow(run, "key long")


class FingerprintIndex:
    """Sorted immutable runs of stretches, bucketed by their anchors, under one shared folder, and marks: which windows repeat.

    A run is never changed: add() writes one, compact() merges all into a new one. A manifest under root says which runs and marks count, how many
    buckets they have, the window and the gram, and where the documents lie that the runs came from, which later batches are verified against. All of
    it changes by one commit; files that a commit makes needless go with the next one, so a run that dies at any point leaves an
    index that can be opened. Whoever opens a root again gets what it was written with; another window, gram or number of buckets
    raises, and so does history whose documents are not to be found: batches that were added without their source need corpus, all
    documents that the index has taken in. A stretch has at most 64 windows, so window - gram < 64."""

    def __init__(self, spark: SparkSession, root: str | None = None, corpus: DataFrame | None = None, buckets: int | None = None, most_runs: int = 4, window: int | None = None, gram: int | None = None, most_log2_bits: int = 27):
        self.spark, self.most_runs, self.most_log2_bits = spark, most_runs, most_log2_bits
        self.root = root or f"{checkpoint_dir(spark)}/fingerprints-{uuid.uuid4().hex}"
        self.manifest = Manifest(spark, self.root)
        self.version, held = self.manifest.read()
        for name, asked, other in (("buckets", buckets, int(spark.conf.get("spark.sql.shuffle.partitions"))), ("window", window, WINDOW), ("gram", gram, GRAM)):
            if held and asked not in (None, held[name]):
                raise ValueError(f"{self.root} was written with {name} = {held[name]}, not {asked}")
            setattr(self, name, held[name] if held else asked or other)
        if not 0 < self.gram <= self.window < self.gram + 64:
            raise ValueError("a window must hold a gram and be shorter than it by less than 64 words")
        self.runs, self.marks, self.sources = (list(held.get(k, [])) for k in ("runs", "marks", "sources"))
        if self.runs and corpus is None:
            if None in self.sources:
                raise ValueError(f"{self.root} holds documents that were added without their source: pass them as corpus")
            for s in self.sources:
                one = spark.read.parquet(s).select("doc_id", "text")
                corpus = one if corpus is None else corpus.unionByName(one)
        self.corpus = corpus

    def _commit(self, dead: list[str] = ()) -> None:
        content = {"buckets": self.buckets, "window": self.window, "gram": self.gram, "runs": self.runs, "marks": self.marks, "sources": self.sources}
        self.version = self.manifest.commit(self.version, content, dead)

    def run(self, name: str) -> DataFrame:
        """A run as the bucketed table it is; made known to the session where it isn't yet."""
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE `{name}` ({RUN.replace('long', 'BIGINT')}) USING parquet CLUSTERED BY (hash) SORTED BY (hash) INTO {self.buckets} BUCKETS LOCATION '{self.root}/{name}'")
        return self.spark.table(name)

    def _write(self, rows: DataFrame) -> str:
        name = f"run_{uuid.uuid4().hex}"
        rows.write.format("parquet").bucketBy(self.buckets, "hash").sortBy("hash").option("path", f"{self.root}/{name}").option("compression", "zstd").saveAsTable(name)
        return name

    def _forget(self, names: list[str]) -> None:
        """Let the session forget these tables; their files stay."""
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS `{name}`")

    def _folded(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("hash", "stretch").agg(F.sum("n").alias("n"), F.min("text_hash").alias("text_hash"))

    def met(self, name: str) -> DataFrame:
        """The batch of that run with what historical runs hold under its anchors: one merge join for each run."""
        own = self.run(name)
        anchors = own.select("hash").distinct()
        out = own
        for other in self.runs:
            if other != name:
                out = out.unionByName(self.run(other).hint("merge").join(anchors, "hash", "left_semi"))
        return self._folded(out)

    def add(self, docs: DataFrame, source: str | None = None) -> None:
        """Enter a batch and mark what it shows to be repeated. source: a Parquet path that keeps the same doc_id and text for later batches
        and sessions."""
        # rows come together by anchor once; the run, its merge joins and its groups keep that partitioning
        rows = stretches(docs, self.window, self.gram).repartition(self.buckets, "hash")
        name = self._write(self._folded(rows))
        anchor = W.partitionBy("hash")
        met = self.met(name).withColumn("low", F.min("stretch").over(anchor)).withColumn("high", F.max("stretch").over(anchor))
        met = settle(met.where("n > 1 or low < high").select("hash", "stretch", "text_hash", (F.col("n") > 1).alias("whole"), (F.col("low") < F.col("high")).alias("parted")))
        self.corpus = docs.select("doc_id", "text") if self.corpus is None else self.corpus.select("doc_id", "text").unionByName(docs.select("doc_id", "text"))
        marks = met.where("whole").select("hash", "stretch", F.lit(-1).cast("long").alias("mask")).unionByName(self.verified(met.where("parted")))
        path = f"marks_{uuid.uuid4().hex}"
        marks.write.option("compression", "zstd").parquet(f"{self.root}/{path}")
        self.runs.append(name)
        self.marks.append(path)
        self.sources.append(source)
        self._commit()
        if len(self.runs) > self.most_runs:
            self.compact()

    def verified(self, wanted: DataFrame) -> DataFrame:
        """(hash, stretch, mask): the windows of wanted stretches (hash, stretch, text_hash) that another of them holds too.

        Bloom filters of the texts and stretches wanted go to every task, so only wanted windows are hashed and sent. A window
        is repeated if two different stretches hold it, however often each was sent."""
        if not wanted.head(1):
            return self.spark.createDataFrame([], MARKS)
        window, gram = self.window, self.gram
        texts, texts_log2 = bloom.of(wanted.select("text_hash").distinct(), self.most_log2_bits)
        keys, keys_log2 = bloom.of(joined_keys(wanted, "hash", "stretch", "text_hash"), self.most_log2_bits)
        sent = self.spark.sparkContext.broadcast((texts, keys))

        def run(batches):
            import pyarrow as pa

            texts, keys = (np.frombuffer(x, np.uint8) for x in sent.value)
            hasher = Hasher(window, gram)
            held, size = [], 0

            def flush():
                cols = [np.concatenate(c) for c in zip(*held, strict=True)]
                return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["kind", "own", "hash", "stretch", "k"])

            for b in small(batches):
                key = b.column(0).to_numpy()
                for i in np.flatnonzero(bloom.holds(texts, key.view(np.uint64), texts_log2)).tolist():
                    if (got := hasher.anchors(b.column(1)[i].as_py())) is None:
                        continue
                    at = np.flatnonzero(bloom.holds(keys, joint(joint(got.hash, got.stretch), np.full(len(got.hash), key[i])), keys_log2))
                    if not len(at):
                        continue
                    row, k, kind, own = got.windows(at)
                    held.append((signed(kind), signed(own), signed(got.hash)[row], signed(got.stretch)[row], k.astype(np.int8)))
                    size += len(row)
                    if size > FLUSH:
                        yield flush()
                        held, size = [], 0
            if held:
                yield flush()

        rows = settle(keyed(self.corpus).select("text_hash", "text").mapInArrow(run, "kind long, own long, hash long, stretch long, k tinyint"))
        again = rows.groupBy("kind", "own").agg(F.min("stretch").alias("low"), F.max("stretch").alias("high")).where("low < high").select("kind", "own")
        # kept apart from its aggregation, so that Spark can split a hot window's rows in the join
        return rows.join(settle(again), ["kind", "own"]).groupBy("hash", "stretch").agg(F.bit_or(F.expr("shiftleft(1L, int(k))")).alias("mask"))

    def repeated(self) -> DataFrame:
        """(hash, stretch, mask): bit k is set if the stretch's k-th window has been met elsewhere too."""
        if not self.marks:
            return self.spark.createDataFrame([], MARKS)
        rows = self.spark.read.schema(MARKS).parquet(*[f"{self.root}/{m}" for m in self.marks])
        return rows.groupBy("hash", "stretch").agg(F.bit_or("mask").alias("mask"))

    def merged(self) -> DataFrame:
        """All runs as one: (hash, stretch, n, text_hash)."""
        out = None
        for name in self.runs:
            out = self.run(name) if out is None else out.unionByName(self.run(name))
        return self.spark.createDataFrame([], RUN) if out is None else self._folded(out)

    def compact(self) -> None:
        """Merge the runs into one, and so the marks; the old ones are removed by the commit after this one."""
        dead, runs, marks = [], self.runs, self.marks
        if len(runs) > 1:
            dead, runs = dead + runs, [self._write(self.merged().repartition(self.buckets, "hash"))]
        if len(marks) > 1:
            path = f"marks_{uuid.uuid4().hex}"
            self.repeated().write.option("compression", "zstd").parquet(f"{self.root}/{path}")
            dead, marks = dead + marks, [path]
        if dead:
            old, self.runs, self.marks = self.runs, runs, marks
            self._commit(dead)
            self._forget([n for n in old if n not in runs])

    def drop(self) -> None:
        """Remove the index and its folder."""
        self._forget(self.runs)
        remove(self.spark, self.root)
        self.runs, self.marks, self.sources, self.corpus, self.version = [], [], [], None, 0


def repeated_spans(docs: DataFrame, index: FingerprintIndex) -> DataFrame:
    """(text_hash, text_check, spans): for each text with repeated windows, array<struct<a, n, mask>>: n windows start at words a, a + 1
    ...; that at a + k is repeated if bit k of mask is set.

    A text that a task meets again is not sent again, so masses of copies stay small."""
    window, gram, marks = index.window, index.gram, index.repeated()
    keys, log2 = bloom.of(joined_keys(marks, "hash", "stretch"), index.most_log2_bits)
    sent = docs.sparkSession.sparkContext.broadcast(keys)

    def run(batches):
        import pyarrow as pa

        bits = np.frombuffer(sent.value, np.uint8)
        hasher = Hasher(window, gram)
        known: set = set()
        for b in small(batches):
            held = []
            for key, check, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if (key, check) in known:
                    continue
                if len(known) >= 100_000:
                    known.clear()
                known.add((key, check))
                if (got := hasher.anchors(text)) is None:
                    continue
                at = np.flatnonzero(bloom.holds(bits, joint(got.hash, got.stretch), log2))
                held.append((signed(got.hash[at]), signed(got.stretch[at]), np.full(len(at), key), np.full(len(at), check, np.int32), got.first[at].astype(np.int32), got.count[at].astype(np.int32)))
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=["hash", "stretch", "text_hash", "text_check", "a", "n"])

    found = keyed(docs).select("text_hash", "text_check", "text").mapInArrow(run, "hash long, stretch long, text_hash long, text_check int, a int, n int")
    # the marks are settled, so that Spark sees their size and can split a hot stretch's rows in the join
    return found.join(settle(marks), ["hash", "stretch"]).groupBy("text_hash", "text_check").agg(F.collect_set(F.struct("a", "n", "mask")).alias("spans"))


def covered(spans, n: int, window: int) -> np.ndarray:
    """Which of n words a repeated window covers."""
    step = np.zeros(n + 1, np.int64)
    for x in spans:
        a, mask = x["a"], x["mask"] & ((1 << x["n"]) - 1)
        while mask:  # runs of set bits
            lo = (mask & -mask).bit_length() - 1
            run = mask >> lo
            length = (~run & (run + 1)).bit_length() - 1
            step[a + lo] += 1
            step[a + lo + length + window - 1] -= 1
            mask &= ~(((1 << length) - 1) << lo)
    return np.cumsum(step[:-1]) > 0


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = 2, index: FingerprintIndex | None = None, most_log2_bits: int = 27) -> DataFrame:
    """Remove every word that a repeated window covers: one whose word sequence also starts elsewhere, in any document here or
    in the index.

    The documents enter the index in batches (by a hash of doc_id), each merge-joined with what is there; the result is the same for any
    number of batches. An index that is given keeps the documents, and what it held before counts as text elsewhere: documents that
    it holds already lose all that their windows cover. Without one, an index of this call's own is removed at the end.

    Returns one row for each row of docs: doc_id, n_words, n_removed, kept (the words that stay, with one space between).
    Windows are judged on the texts as they come. Null and empty texts have no words; rows of one doc_id, also null, are documents
    of their own, so copies remove each other. Texts shorter than a window stay. An empty table gives no rows; columns other than doc_id and text are ignored.
    Texts, stretches and windows are equal if their hashes (96, 128 and 128 bits) are."""
    own = index is None
    index = index or FingerprintIndex(docs.sparkSession, window=window, gram=gram, most_log2_bits=most_log2_bits)
    window = index.window
    for k in range(batches):
        index.add(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k) if batches > 1 else docs)
    index.compact()
    spans = settle(repeated_spans(docs, index))
    if own:
        index.drop()

    def rewrite(stream):
        import pyarrow as pa

        for b in small(stream):
            out = []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = text.split()
                n = len(words)
                if spans:
                    words = [words[i] for i in np.flatnonzero(~covered(spans, n, window)).tolist()]
                out.append((n, n - len(words), b" ".join(words)))
            n, gone, kept = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])

    def whole(stream):
        import pyarrow as pa

        yield from rewrite(pa.RecordBatch.from_arrays([b.column(2), b.column(3), pa.nulls(b.num_rows)], names=["doc_id", "text", "spans"]) for b in split.without(stream))

    # only texts that may have a repeated window are sent to meet their spans
    rows = keyed(docs).select("text_hash", "text_check", "doc_id", "text")
    split = bloom.Split(spans.select("text_hash"), most_log2_bits)
    touched = rows.mapInArrow(split.within, rows.schema).join(spans, ["text_hash", "text_check"], "left").select("doc_id", "text", "spans")
    schema = "doc_id long, n_words long, n_removed long, kept binary"
    return rows.mapInArrow(whole, schema).unionByName(touched.mapInArrow(rewrite, schema)).withColumn("kept", F.col("kept").cast("string"))
