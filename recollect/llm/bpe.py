"""Byte-level BPE: a minimal perfect hash resolves whole pre-tokens, a heap over linked bytes merges the rest."""

from __future__ import annotations

import base64
import hashlib
from array import array
from heapq import heapify, heappop, heappush

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from .common import U64, mix, small

#: Pre-tokens that a task remembers at most; past it the memory starts anew.
MEMO = 300_000


def read_ranks(path: str) -> list[bytes]:
    """The token bytes by rank of a .tiktoken file (gapless ranks)."""
    with open(path, "rb") as f:
        ranks = {int(n): base64.b64decode(t) for t, n in (line.split() for line in f if line.strip())}
    return [ranks[i] for i in range(len(ranks))]


def hashes(keys: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


class PerfectHash:
    """A minimal perfect hash of n keys by hash and displace: slot = mix(hash + seed of its bucket) mod n."""

    def __init__(self, n: int, seeds: np.ndarray, slots: np.ndarray):
        #: the seed of each bucket, and the key in each slot
        self.n, self.seeds, self.slots = n, seeds, slots

    @classmethod
    def build(cls, keys: list[bytes], per_bucket: int = 3) -> PerfectHash:
        n = len(keys)
        h = hashes(keys)
        if len(np.unique(h)) < n:
            raise ValueError("keys repeat, or hash alike")  # no seed could part them
        buckets = max(1, n // per_bucket)
        bucket = (h % U64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=buckets)
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        seeds, slots = np.zeros(buckets, np.uint64), np.full(n, -1, np.int64)
        tries = np.arange(256, dtype=np.uint64)
        for b in np.argsort(-sizes, kind="stable").tolist():  # the fullest first
            if not sizes[b]:
                break
            own = order[starts[b] : starts[b] + sizes[b]]
            first = 0
            while True:
                at = (mix(h[own][None, :] + (tries[:, None] + U64(first)) * U64(0x9E3779B97F4A7C15)) % U64(n)).astype(np.int64)
                ok = (slots[at] < 0).all(axis=1)
                if len(own) > 1:
                    s = np.sort(at, axis=1)
                    ok &= (s[:, 1:] != s[:, :-1]).all(axis=1)
                if ok.any():
                    k = int(np.argmax(ok))
                    seeds[b] = first + k
                    slots[at[k]] = own
                    break
                first += len(tries)
        return cls(n, seeds, slots)

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The number of the only key that each may equal."""
        if not self.n:
            return np.full(len(keys), -1)
        h = hashes(keys)
        seed = self.seeds[(h % U64(len(self.seeds))).astype(np.int64)]
        return self.slots[(mix(h + seed * U64(0x9E3779B97F4A7C15)) % U64(self.n)).astype(np.int64)]


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The tokens of one pre-token: always the pair of least rank merges, of equal ones the leftmost."""
    n = len(word)
    end = list(range(1, n + 1))  # of the part that starts here
    before = list(range(-1, n - 1))  # start of the part on the left
    heap = []
    for i in range(n - 1):
        r = ranks.get(word[i : i + 2])
        if r is not None:
            heap.append((r, i, i + 2))
    heapify(heap)
    while heap:
        r, i, stop = heappop(heap)
        j = end[i]
        if j < 0 or j >= n or end[j] != stop:  # a part of this pair has merged already
            continue
        end[i], end[j] = stop, -1
        if stop < n:
            before[stop] = i
            new = ranks.get(word[i : end[stop]])
            if new is not None:
                heappush(heap, (new, i, end[stop]))
        left = before[i]
        if left >= 0:
            new = ranks.get(word[left:stop])
            if new is not None:
                heappush(heap, (new, left, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Codec:
    """Encodes and decodes with one vocabulary. Lives in a task; tables come by broadcast."""

    def __init__(self, tokens: list[bytes], table: PerfectHash, pattern: str):
        import regex

        self.tokens, self.table = tokens, table
        self.ranks = {t: i for i, t in enumerate(tokens)}
        self.split = regex.compile(pattern).findall
        self.memo: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        """Put the ids of new pre-tokens into the memory, as little-endian unsigned 32-bit integers."""
        raw = [w.encode() for w in words]
        memo, tokens, ranks = self.memo, self.tokens, self.ranks
        for w, r, k in zip(words, raw, self.table.find(raw).tolist(), strict=True):
            memo[w] = k.to_bytes(4, "little") if k >= 0 and tokens[k] == r else array("I", merge(r, ranks)).tobytes()

    def encode(self, text: str) -> bytes:
        words = self.split(text)
        new = set(words).difference(self.memo)
        if new:
            if len(self.memo) + len(new) > MEMO:
                self.memo.clear()
                new = set(words)
            self.learn(list(new))
        return b"".join(map(self.memo.__getitem__, words))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, array("I", ids)))


def bpe(docs: DataFrame, vocabulary: str, pattern: str, outputs: tuple[str, ...] = ("ids", "decoded"), carry: tuple[str, ...] = ()) -> DataFrame:
    """Encode every text with the ranks in the file vocabulary (read on the driver, broadcast: its size is fixed),
    each match of pattern apart, without special tokens; then decode the ids.

    Returns one row for each row of docs: doc_id, n_tokens, the outputs asked for of ids (array<int>), decoded (binary),
    ids_sha256 (of little-endian unsigned 32-bit integers) and decoded_sha256, and the columns in carry, whatever their names. Null and
    empty texts have no tokens; null doc_ids and repeated rows each get their row; an empty table gives no rows. The ids of one text, of any
    length, are in memory at a time, and at most MEMO pre-tokens."""
    import pyarrow as pa

    spark = docs.sparkSession
    tokens = read_ranks(vocabulary)
    table = PerfectHash.build(tokens)
    sent = spark.sparkContext.broadcast((tokens, table.n, table.seeds, table.slots))
    kinds = {"ids": (ArrayType(IntegerType()), pa.list_(pa.int32())), "decoded": (BinaryType(), pa.binary()), "ids_sha256": (StringType(), pa.string()), "decoded_sha256": (StringType(), pa.string())}
    arrow = {o: kinds[o][1] for o in outputs}
    more = [c for c in carry if c != "doc_id"]
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.struct(F.lit(0).alias("doc_id"), *more).alias("carried"))
    schema = StructType([StructField("doc_id", LongType()), StructField("n_tokens", LongType()), *(StructField(o, kinds[o][0]) for o in outputs), source.schema["carried"]])

    def run(batches):
        tokens, *table = sent.value
        codec = Codec(tokens, PerfectHash(*table), pattern)
        for b in small(batches):
            n, got = [], {o: [] for o in outputs}
            for text in b.column(1).to_pylist():
                ids = codec.encode(text)
                n.append(len(ids) // 4)
                if "ids" in got:
                    got["ids"].append(np.frombuffer(ids, np.int32))
                if "ids_sha256" in got:
                    got["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                if "decoded" in got or "decoded_sha256" in got:
                    back = codec.decode(ids)
                    if "decoded" in got:
                        got["decoded"].append(back)
                    if "decoded_sha256" in got:
                        got["decoded_sha256"].append(hashlib.sha256(back).hexdigest())
            cols = [b.column(0), pa.array(n, pa.int64()), *(pa.array(got[o], arrow[o]) for o in outputs), b.column(2)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", *outputs, "carried"])

    return source.mapInArrow(run, schema).select("doc_id", "n_tokens", *outputs, *[F.col("carried")[c].alias(c) for c in more])
