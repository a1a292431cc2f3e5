"""Where passages break in runs of segments, found by many tasks at once however long one item is.

All segments are counted through in the order of their items and dealt out in blocks of equal size, with as many rows around them as a passage may
take. A passage is known by its state (a, i): it begins with segment a, and i is the first that the passage before it hadn't. From a state the next one
follows by binary search in prefix sums. What a block does to each state that an item may enter it with is found in all blocks at once; joins that
double their stride tell which of them it is; then every block cuts its own passages."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate, groupby, pairwise

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import counted, settle

STATE = "b long, a long, i long"


class Run:
    """Neighbouring segments of one item: their lengths, starts and ends."""

    def __init__(self, sizes: list, starts: list, ends: list, most: int, overlap: int, seconds: float):
        self.sums, self.starts, self.reach = [0, *accumulate(sizes)], starts, [e or s for s, e in zip(starts, ends, strict=True)]
        self.most, self.overlap, self.seconds = most, overlap, seconds
        self.rising = all(p <= q for p, q in pairwise(self.reach))

    def carried(self, j: int, after: int = -1) -> int:
        """The last segment after the given one from which to j overlap characters lie; j if there is none."""
        k = bisect_right(self.sums, self.sums[j] - self.overlap, after + 1, j) - 1
        return k if k > after and self.overlap > 0 else j

    def after(self, a: int, i: int) -> tuple[int, int]:
        """The state that follows: j is the first segment after i that makes the passage too long, the run's length if none does."""
        j = max(bisect_right(self.sums, self.sums[a] + self.most, i + 1) - 1, i + 1)
        begun = self.starts[a]
        if self.rising:
            j = bisect_right(self.reach, self.seconds, i + 1, j, key=lambda t: t - begun)
        else:
            j = next((k for k in range(i + 1, j) if self.reach[k] - begun > self.seconds), j)
        return self.carried(j, a), j

    def entries(self, at: int) -> list[tuple[int, int]]:
        """All states that a passage begun before segment at may be followed by from there on."""
        last = bisect_right(self.sums, self.sums[at] + self.most, at, len(self.starts)) - 1
        return sorted({s for i in range(at, max(last, at) + 1) for s in ((i, i), (self.carried(i), i))})

    def leaves(self, states: list, end: int) -> dict:
        """For each state the first one from segment end on that it leads to; each state on the way is passed once."""
        known = {}
        for s in states:
            way = []
            while s[1] < end and s not in known:
                way.append(s)
                s = self.after(*s)
            out = known.get(s, s)
            known.update(dict.fromkeys(way, out))
        return {s: known.get(s, s) for s in states}


def numbered(rows: DataFrame) -> DataFrame:
    """rows with pos: their place in the order of item and seq (then start, end and text's hash)."""
    return counted(rows, [F.col(c) for c in ("item_id", "seq", "start", "end")] + [F.xxhash64("text")], "pos")


def in_blocks(rows: DataFrame, block: int, back: int, ahead: int) -> DataFrame:
    """rows with the blocks b that need them: their own, and those which begin or end near by."""
    return rows.withColumn("b", F.explode(F.sequence(F.greatest(F.floor((F.col("pos") - ahead) / block), F.lit(0)), F.floor((F.col("pos") + back) / block))))


def _groups(batches):
    """(b, rows) of sorted Arrow batches whose first column is b."""

    def rows():
        for t in batches:
            yield from zip(*(c.to_pylist() for c in t.columns), strict=True)

    return groupby(rows(), key=lambda r: r[0])


def _tables(rows, schema, size: int = 2000):
    """rows as Arrow batches."""
    from itertools import islice

    import pyarrow as pa

    rows = iter(rows)
    while part := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)


def exits(rows: DataFrame, block: int, most: int, overlap: int, seconds: float) -> DataFrame:
    """(b, a, i, na, ni): an item that enters block b in state (a, i) enters the next in (na, ni). a and i are null where it begins in b."""

    def leave(batches):
        import pyarrow as pa

        def out():
            for b, own in _groups(batches):
                low, high = b * block, (b + 1) * block
                for _, run in groupby(own, key=lambda r: r[2]):
                    _, pos, _, sizes, starts, ends = (list(c) for c in zip(*run, strict=True))
                    at = pos[0]
                    if pos[-1] < high or at >= high:
                        continue
                    here = Run(sizes, starts, ends, most, overlap, seconds)
                    for s, t in here.leaves([(0, 0)] if at >= low else here.entries(low - at), high - at).items():
                        if t[1] < len(pos):
                            yield (b, *((None, None) if at >= low else (s[0] + at, s[1] + at)), t[0] + at, t[1] + at)

        return _tables(out(), pa.schema([(n, pa.int64()) for n in ("b", "a", "i", "na", "ni")]))

    return rows.select("b", "pos", "item_id", "size", "start", "end").repartition("b").sortWithinPartitions("b", "pos").mapInArrow(leave, f"{STATE}, na long, ni long")


def entered(exits: DataFrame) -> DataFrame:
    """(b, a, i): the state in which an item that has begun before block b enters it. Blocks that an item fills are stepped through in strides of
    1, 2, 4 and so on, in as many rounds as their number has binary digits."""
    exits = settle(exits)
    known = exits.where("a is null").select((F.col("b") + 1).alias("b"), F.col("na").alias("a"), F.col("ni").alias("i"))
    step = exits.where("a is not null").select("b", "a", "i", (F.col("b") + 1).alias("nb"), "na", "ni")
    while not step.isEmpty():
        to = known.join(step, ["b", "a", "i"]).select(F.col("nb").alias("b"), F.col("na").alias("a"), F.col("ni").alias("i"))
        known = settle(known.unionByName(to))
        on = step.select(F.col("b").alias("nb"), F.col("a").alias("na"), F.col("i").alias("ni"), F.col("nb").alias("mb"), F.col("na").alias("ma"), F.col("ni").alias("mi"))
        step = settle(step.join(on, ["nb", "na", "ni"]).select("b", "a", "i", F.col("mb").alias("nb"), F.col("ma").alias("na"), F.col("mi").alias("ni")))
    return known


def passages(segments: DataFrame, most: int, overlap: int, seconds: float, least: int, block: int) -> DataFrame:
    """(item_id, ordinal, text, start, end) from (item_id, seq, text, start, end), texts clean and not empty."""
    if block <= most:
        raise ValueError(f"a block of {block} segments may be shorter than a passage of {most} characters")
    back, ahead = max(overlap, 1), max(most, 1) + 1
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("start", "end")]
    rows = in_blocks(numbered(segments.select("item_id", "seq", "text", *zero, F.length("text").alias("size"))), block, back, ahead)
    states = entered(exits(rows, block, most, overlap, seconds))

    def cut(batches):
        import unicodedata

        import pyarrow as pa

        def out():
            for b, own in _groups(batches):
                low, high, state = b * block, (b + 1) * block, None
                for (is_state, item), run in groupby(own, key=lambda r: (r[1] < 0, r[2])):
                    if is_state:
                        state = next(run)[-2:]
                        continue
                    _, pos, _, texts, sizes, starts, ends, _, _ = (list(c) for c in zip(*run, strict=True))
                    at, here, k = pos[0], Run(sizes, starts, ends, most, overlap, seconds), 0
                    more = at < low
                    if at >= high or more and (state is None or pos[-1] < low):
                        continue
                    s = (state[0] - at, state[1] - at) if more else (0, 0)
                    while s[1] < min(high - at, len(pos)):
                        a, (c, j) = s[0], here.after(*s)
                        text = " ".join(texts[a:j])
                        if len(" ".join(unicodedata.normalize("NFKC", text).split())) >= least:
                            yield b, more, more or pos[-1] >= high, item, k, text, starts[a], ends[j - 1] or starts[j - 1]
                            k += 1
                        s = c, j

        kinds = (pa.int64(), pa.bool_(), pa.bool_(), pa.string(), pa.int64(), pa.string(), pa.float64(), pa.float64())
        return _tables(out(), pa.schema(list(zip(("b", "more", "spans", "item_id", "k", "text", "start", "end"), kinds, strict=True))))

    columns = ["b", "pos", "item_id", "text", "size", "start", "end", "a", "i"]
    every = rows.drop("seq").unionByName(states.withColumn("pos", F.lit(-1).cast("long")), allowMissingColumns=True).select(columns)
    found = settle(every.repartition("b").sortWithinPartitions("b", "pos").mapInArrow(cut, "b long, more boolean, spans boolean, item_id string, k long, text string, start double, end double"))
    return found.join(earlier(found), "b", "left").select("item_id", (F.col("k") + F.when(F.col("more"), F.coalesce("earlier", F.lit(0))).otherwise(0)).cast("int").alias("ordinal"), "text", "start", "end")


def earlier(found: DataFrame) -> DataFrame:
    """(b, earlier): how many passages the item that enters block b has before it; one row for each block that an item has passages in is summed."""
    from pyspark.sql import Window as W

    n = found.where("spans").groupBy("item_id", "b", "more").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("item_id").orderBy("b").rowsBetween(W.unboundedPreceding, -1))
    return n.withColumn("earlier", before).where("more").select("b", "earlier")
