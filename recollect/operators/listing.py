"""A listing of items that is read by the page: items lie in the order in which they are listed, counted through, in zones of some tens, and each zone has a
signature of all character trigrams in its titles, authors and descriptions.

A page of everything is a range of places. One that filters reads on from its first place in stretches that grow fourfold until it is full. Text is
sought only in zones whose signature has all trigrams of what is sought; what they hold is compared letter by letter, so that pages are those of
library.list_items()."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from . import library as L
from .index import GROUP, name_tokens
from .shared import Scratch, counted

#: Bits of a signature: those of one bitmap_construct_agg().
BITS = 32_768
#: Items whose trigrams one task brings into signatures. Their bits are rows until then, some thousand of an item, and are sorted by zone.
AT_ONCE = 2048
ORDER = (F.desc, "saved_at"), (F.desc, "indexed_at"), (F.asc, "id")


def grams(text: Column) -> Column:
    """array<long>: the signature's bits for each three neighbouring characters."""
    bit = lambda c, i: F.pmod(F.xxhash64(*[F.element_at(c, i + k) for k in range(3)]), F.lit(BITS))
    none = F.array().cast("array<bigint>")
    return let(F.split(F.coalesce(text, F.lit("")), ""), lambda c: F.when(F.size(c) < 3, none).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(c) - 2, F.lit(1))), lambda i: bit(c, i))))


def has_bit(sign: Column, bit: int) -> Column:
    byte = F.conv(F.hex(F.substring(sign, bit // 8 + 1, 1)), 16, 10).cast("int")
    return F.shiftright(byte, bit % 8).bitwiseAND(F.lit(1)) == 1


def signatures(rows: DataFrame, n: int) -> DataFrame:
    """(_zone, n, sign) of n rows with _zone. Zones are dealt out in ranges, in as many tasks as the items want, so that what one of them sorts does not grow
    with the listing."""
    bits = F.flatten(F.array(*[grams(F.lower(F.col(c))) for c in L.SEARCHED]))
    dealt = rows.select("_zone", *L.SEARCHED).repartitionByRange(max(1, -(-n // AT_ONCE)), "_zone")
    # an item without any trigram counts in its zone; a zone of none has no signature
    each = dealt.select("_zone", F.posexplode_outer(F.array_distinct(bits)).alias("nth", "bit"))
    return each.groupBy("_zone").agg(F.count_if(F.coalesce("nth", F.lit(0)) == 0).alias("n"), F.bitmap_construct_agg("bit").alias("sign"), F.count("bit").alias("_bits")).select("_zone", "n", F.when(F.col("_bits") > 0, F.col("sign")).alias("sign"))


@dataclass
class Listing:
    """rows: the items with _pos and _zone; heads: _zone, n, sign. Items may have any columns beside those that list_items() asks for, but none of these names."""

    rows: DataFrame
    heads: DataFrame
    n: int
    zone: int

    @staticmethod
    def write(items: DataFrame, root: str, zone: int = 32) -> Listing:
        """List items (see library.list_items()) in files under root. Small row groups and pages let a scan skip what lies between the places it is asked for."""
        placed = counted(items, [o(F.col(c)) for o, c in ORDER], "_pos").withColumn("_zone", F.floor(F.col("_pos") / zone))
        pages = {"compression": "zstd", "parquet.block.size": str(8 << 20), "parquet.page.row.count.limit": "512"}
        placed.sortWithinPartitions("_pos").write.options(**pages).parquet(f"{root}/rows")
        rows = items.sparkSession.read.parquet(f"{root}/rows")
        scratch = Scratch(items.sparkSession)
        # held, for ranges are sampled first, which would make all signatures twice
        scratch.hold(signatures(rows, rows.count())).repartitionByRange("_zone").sortWithinPartitions("_zone").write.options(**pages).parquet(f"{root}/heads")
        scratch.release()
        return Listing.read(items.sparkSession, root, zone)

    @staticmethod
    def read(spark: SparkSession, root: str, zone: int = 32) -> Listing:
        heads = spark.read.parquet(f"{root}/heads")
        return Listing(spark.read.parquet(f"{root}/rows"), heads, heads.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], zone)

    def zones(self, query: str, first: int = 0, end: int | None = None) -> DataFrame:
        """(_zone): the zones with places from first to before end that may hold query; all of them if it has under three characters."""
        end = self.n if end is None else end
        heads = self.heads.where(F.col("_zone").between(first // self.zone, max(end - 1, 0) // self.zone))
        bits = heads.sparkSession.range(1).select(grams(F.lit(query.lower())).alias("b")).first().b
        for bit in sorted(set(bits)):
            heads = heads.where(has_bit(F.col("sign"), bit))
        return heads.select("_zone")

    def between(self, first: int, end: int, query: str = "", **filters: str) -> DataFrame:
        """The items at places from first to before end that meet the filters of library.list_items(), in no order."""
        rows = self.rows.where((F.col("_pos") >= first) & (F.col("_pos") < end))
        if len(query) >= 3:
            name_tokens(self.rows.sparkSession)
            zones = self.zones(query, first, end)
            some = [r[0] for r in zones.limit(GROUP + 1).collect()]
            rows = rows.where(F.col("_zone").isin(some)) if len(some) <= GROUP else rows.join(zones, "_zone", "left_semi")
        return L.meeting(rows, query=query, **filters)

    def page(self, query: str = "", limit: int = 100, offset: int = 0, after: int = -1, stretch: int = 4096, **filters: str) -> DataFrame:
        """The page that library.list_items() gives with the same arguments, with _pos. after: the _pos of the last item of the page before, from which on this one
        goes, whatever has been skipped until there."""
        first, need = after + 1, offset + limit
        if not query and not any(filters.values()):
            return self.between(first + offset, min(first + need, self.n)).drop("_zone").orderBy("_pos")
        wide = max(stretch, 4 * need)
        while True:
            found = self.between(first, min(first + wide, self.n), query, **filters)
            if first + wide >= self.n or found.limit(need).count() >= need:
                return found.drop("_zone").orderBy("_pos").offset(offset).limit(limit)
            wide *= 4
