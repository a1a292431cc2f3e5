"""A quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw, small

FEATURES = ("bytes", "words", "mean_word", "spread_word", "distinct_words", "upper", "digits", "stops", "symbols", "bangs", "bars", "other_ascii", "beyond_ascii", "spaces", "lines", "duplicate_lines", "top_word", "same_neighbours", "distinct_pairs", "entropy", "longest_word")


def features(text: bytes) -> list[float]:
    """Statistics of one text; all are finite, of the empty text too."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if text else np.zeros(256, np.int64)
    size = max(1, len(text))
    words = text.split()
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n) if n else np.zeros(1, np.int64)
    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    share = counts / size
    some = share[share > 0]
    of = lambda chars: float(share[np.frombuffer(chars, np.uint8)].sum())
    return [
        float(np.log1p(len(text))),
        float(np.log1p(n)),
        float(lengths.mean()),
        float(lengths.std()),
        len(tally) / max(1, n),
        float(share[65:91].sum()),
        float(share[48:58].sum()),
        of(b".,;:"),
        of(b"#*$%&<>"),
        of(b"!?"),
        of(b"|"),
        of(b"\"'()+-/=@[\\]^_`{}~"),
        float(share[128:].sum()),
        of(b" \t\n\x0b\x0c\r"),
        len(lines) / max(1, n),
        1 - len(set(lines)) / max(1, len(lines)),
        max(tally.values(), default=0) / max(1, n),
        sum(map(bytes.__eq__, words, words[1:])) / max(1, n),
        len(set(zip(words, words[1:], strict=False))) / max(1, n - 1),
        float(-(some * np.log2(some)).sum()),
        float(np.log1p(lengths.max())),
    ]


@dataclass
class Trees:
    """Complete trees of one depth as arrays: node k has children 2k + 1 and 2k + 2; leaves follow the inner nodes."""

    feature: np.ndarray  # (trees, 2**depth - 1)
    cut: np.ndarray  # (trees, 2**depth - 1): greater goes right
    leaf: np.ndarray  # (trees, 2**depth)
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1, all rows moving down a tree together."""
        total = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            total += leaf[at - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.1, bins: int = 64, least: float = 5.0, ridge: float = 1.0) -> Trees:
    """Boost on the logistic loss. Each feature is binned by quantiles once; splits are sought on histograms of
    gradients per node and bin. Without rows, or with one label alone, the trees are flat."""
    n, width = x.shape
    inner, leaves = 2**depth - 1, 2**depth
    mean = float(np.clip(y.mean() if n else 0.5, 0.01, 0.99))
    out = Trees(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)), float(np.log(mean / (1 - mean))))
    if not n:
        return out
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    score = np.full(n, out.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            lo, nodes = 2**level - 1, 2**level
            local = at - lo
            best = np.full(nodes, 1e-6)
            for j in range(width):
                k = len(edges[j])
                if not k:
                    continue
                place = local * (k + 1) + binned[:, j]
                gs = np.bincount(place, g, nodes * (k + 1)).reshape(nodes, k + 1).cumsum(axis=1)
                hs = np.bincount(place, h, nodes * (k + 1)).reshape(nodes, k + 1).cumsum(axis=1)
                ga, ha = gs[:, -1:], hs[:, -1:]
                gl, hl = gs[:, :-1], hs[:, :-1]
                gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
                gain[(hl < least / 10) | (ha - hl < least / 10)] = 0
                b = gain.argmax(axis=1)
                value = gain[np.arange(nodes), b]
                for i in np.flatnonzero(value > best):
                    best[i] = value[i]
                    out.feature[t, lo + i], out.cut[t, lo + i] = j, edges[j][b[i]]
            f, c = out.feature[t, at], out.cut[t, at]
            at = 2 * at + 1 + (x[np.arange(n), f] > c)
        place = at - inner
        out.leaf[t] = rate * np.bincount(place, g, leaves) / (np.bincount(place, h, leaves) + ridge)
        score += out.leaf[t][place]
    return out


def document_features(docs: DataFrame) -> DataFrame:
    """doc_id and f, the statistics of the text."""

    def run(batches):
        import pyarrow as pa

        for b in small(batches):
            x = [features(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "f"])

    return raw(docs).mapInArrow(run, "doc_id long, f array<double>")


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = 20_000, **options) -> Trees:
    """Fit on at most sample_rows labelled documents that are not held out, chosen by a hash of doc_id.

    Only the sample's ids are broadcast, and only its statistics (21 numbers a row) reach the driver."""
    own = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    chosen = [tuple(r) for r in own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).collect()]
    if not chosen:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0), **options)
    sample = docs.sparkSession.createDataFrame(chosen, "doc_id long, y int")
    texts = docs.join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi")
    rows = sorted(document_features(texts).groupBy("doc_id").agg(F.min("f").alias("f")).join(F.broadcast(sample), "doc_id").select("doc_id", "f", "y").collect())
    return fit(np.array([r.f for r in rows]).reshape(-1, len(FEATURES)), np.array([r.y for r in rows], float), **options)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, model: Trees | None = None, **options) -> DataFrame:
    """Score every whole text: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (score >= threshold).

    Rows whose crc32(doc_id as text) is divisible by 5 are held out of training. Labels, lang, source and doc_id are no
    inputs. Null and empty texts have a score too. A null doc_id is not held out. Repeated rows score alike; an empty table gives no rows;
    texts of any length are read whole; columns other than doc_id and text are ignored."""
    trees = model or train(docs, labels, **options)
    sent = docs.sparkSession.sparkContext.broadcast((trees.feature, trees.cut, trees.leaf, trees.base))

    def run(batches):
        import pyarrow as pa

        forest = Trees(*sent.value)
        for b in small(batches):
            x = np.array([features(t) for t in b.column(1).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(forest.scores(x))], names=["doc_id", "score"])

    out = raw(docs).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
