"""Benchmark decontamination: exact hits of item pieces, verified by bit-parallel edit distance."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from . import bloom
from .common import settle, small

ERROR_RATE = 0.05
#: Benchmark text (code points) that is held, and broadcast, at a time.
BLOCK_CHARS = 2_000_000


def normal(text: str) -> str:
    """A-Z lower-cased (as all letters are), white space folded."""
    return " ".join(text.lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 pieces of near equal length, with their offsets."""
    cuts = [len(item) * k // (budget + 1) for k in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]


def myers(pattern: str, text: str, most: int) -> int:
    """The least edit distance between pattern and any substring of text, if at most most; else most + 1."""
    m = len(pattern)
    eq: dict[str, int] = {}
    for i, ch in enumerate(pattern):
        eq[ch] = eq.get(ch, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, min(m, most + 1)
    for ch in text:
        e = eq.get(ch, 0)
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            best = min(best, score)
        ph = ph << 1 & full  # a match may start anywhere: nothing is carried in
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
    return best


def search(text: str, items: list[tuple[int, str, int]], automaton) -> dict[int, int]:
    """item_id to its least distance in the text, for items within their budgets."""
    spans: dict[int, list[list[int]]] = {}
    for end, hits in automaton.iter(text):
        for k, offset, length in hits:
            _, item, budget = items[k]
            start = end + 1 - length - offset
            lo, hi = max(0, start - budget), min(len(text), start + len(item) + budget)
            own = spans.setdefault(k, [])
            if own and lo <= own[-1][1] and hi >= own[-1][0]:  # one stretch for hits that meet
                own[-1][0], own[-1][1] = min(own[-1][0], lo), max(own[-1][1], hi)
            else:
                own.append([lo, hi])
    found: dict[int, int] = {}
    for k, own in spans.items():
        item_id, item, budget = items[k]
        best = budget + 1
        for lo, hi in own:
            best = 0 if item in text[lo:hi] else min(best, myers(item, text[lo:hi], budget))
            if best == 0:
                break
        if best <= budget:
            found[item_id] = min(best, found.get(item_id, best))
    return found


def searcher(items: list[tuple[int, str, int]]):
    """text to {item_id: distance}, for (item_id, normal text, budget)."""
    import ahocorasick

    if not items:
        return lambda text: {}
    by_piece: dict[str, list] = {}
    for k, (_, item, budget) in enumerate(items):
        for offset, piece in pieces(item, budget):
            by_piece.setdefault(piece, []).append((k, offset, len(piece)))
    automaton = ahocorasick.Automaton()
    for piece, uses in by_piece.items():
        automaton.add_word(piece, uses)
    automaton.make_automaton()
    return lambda text: search(normal(text), items, automaton)


def item_blocks(benchmark: DataFrame, error_rate: float, block_chars: int):
    """Lists of (item_id, normal text, budget) of block_chars characters at most, or one item."""
    block, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").toLocalIterator():
        item = normal(r.text)
        if not item:
            continue
        if block and size + len(item) > block_chars:
            yield block
            block, size = [], 0
        block.append((r.item_id, item, int(error_rate * len(item))))
        size += len(item)
    if block:
        yield block


FOUND = ArrayType(StructType([StructField("item_id", LongType()), StructField("distance", IntegerType())]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Which benchmark items each document holds, with up to error_rate of an item's characters edited.

    An item of m characters has a budget of floor(error_rate * m) edits. Of budget + 1 pieces one at least
    survives unedited in any such copy; pieces are found exactly with an automaton, and the stretch around each hit is
    verified. Case and white space don't count. The items are read in blocks of block_chars characters at most (or
    one item). One block is broadcast and the documents pass it in a map step, without a shuffle. Of more, each is broadcast, searched
    for and settled before the next, so that a task holds one automaton only; just the hits are kept, and meet their texts at the end.

    Returns one row for each row of docs: doc_id, item_ids (ascending), distances (in that order), contaminated, and
    the columns named in carry, whatever their names (text: null becomes empty). Null and empty texts hold nothing; null and blank items are never found; items
    that share an item_id count as one, at the least distance. Repeated rows and null doc_ids each get their row; an empty table gives no rows."""
    spark = docs.sparkSession
    more = [c for c in carry if c not in ("doc_id", "text")]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.xxhash64(text).alias("row"), text.alias("text"), F.col("doc_id").cast("long").alias("doc_id"), F.struct(F.lit(0).alias("doc_id"), *more).alias("carried"))
    blocks = item_blocks(benchmark, error_rate, block_chars)
    first, second = next(blocks, []), next(blocks, None)

    if second is None:
        sent = spark.sparkContext.broadcast(first)

        def scan(batches):
            import pyarrow as pa

            find = searcher(sent.value)
            kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32())]))
            for b in small(batches):
                col = [[{"item_id": i, "distance": d} for i, d in sorted(find(t).items())] for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(col, kind)], names=[*b.schema.names, "found"])

        out = rows.mapInArrow(scan, StructType([*rows.schema.fields, StructField("found", FOUND)]))
    else:
        hits = None
        for block in chain([first, second], blocks):
            sent = spark.sparkContext.broadcast(block)

            def hit(batches, sent=sent):
                import pyarrow as pa

                find = searcher(sent.value)
                for b in small(batches):
                    got = [(row, i, d) for row, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, d in find(t).items()]
                    cols = zip(*got, strict=True) if got else ((), (), ())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["row", "item_id", "distance"])

            own = settle(rows.select("row", "text").mapInArrow(hit, "row long, item_id long, distance int"))
            sent.unpersist()
            hits = own if hits is None else hits.unionByName(own)
        least = hits.groupBy("row", "item_id").agg(F.min("distance").alias("distance"))
        found = settle(least.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("item_id", "distance"))).alias("found")))
        split = bloom.Split(found.select("row"))
        clean, met = rows.mapInArrow(split.without, rows.schema), rows.mapInArrow(split.within, rows.schema)
        out = clean.withColumn("found", F.array().cast(FOUND)).unionByName(met.join(found, "row", "left").withColumn("found", F.coalesce("found", F.array().cast(FOUND))))
    taken = [F.col("text") if c == "text" else F.col("carried")[c].alias(c) for c in carry if c != "doc_id"]
    return out.select("doc_id", F.col("found.item_id").alias("item_ids"), F.col("found.distance").alias("distances"), (F.size("found") > 0).alias("contaminated"), *taken)
