"""Work that several workers share: rows that stay open until someone has done them, taken on leases that run out.

Workers are jobs of their own that know nothing of each other. A claim is one commit of a manifest, so that of two workers that want the same rows one
wins, and the other looks again. What is done is kept as a list beside the open rows until there is a quarter as much of it, and then left out of them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..operators.manifest import Conflict, Manifest
from ..operators.shared import settle
from .store import Store

SCHEMAS = {"open": "id string, at double, batch long", "leases": "id string, at double, batch long, tries int, worker string, until double", "closed": "id string, batch long"}
KEY = ["id", "batch"]


class Queue:
    """A queue under root. lease: how long a claim holds, in the unit of the times given as now; tries: claims after which a row that wasn't done is given up."""

    def __init__(self, spark: SparkSession, root: str, lease: float = 600.0, tries: int = 3):
        self.spark, self.root, self.lease, self.tries, self.manifest = spark, root, lease, tries, Manifest(spark, root)

    # --- what there is -----------------------------------------------------------------------------------------------

    def waiting(self) -> DataFrame:
        """(id, at, batch, tries, worker, until): every open row, with its last claim if there was one."""
        held = self._held()[1]
        return self._open(held).join(self._of(held, "leases").drop("at"), KEY, "left").withColumn("tries", F.coalesce("tries", F.lit(0)))

    def given_up(self) -> DataFrame:
        """The open rows that were claimed as often as they may be, and not done."""
        return self.waiting().where(F.col("tries") >= self.tries)

    # --- changes -----------------------------------------------------------------------------------------------------

    def add(self, rows: DataFrame) -> int:
        """Open rows (id, at), the earliest of each id; those that are open already stay as they are. Returns how many are new."""
        rows = settle(rows.where("id is not null").groupBy("id").agg(F.min(F.col("at").cast("double")).alias("at")))

        def change(held, version):
            new = settle(rows.join(self._open(held), "id", "left_anti").withColumn("batch", F.lit(version + 1).cast("long")))
            n = new.count()
            return n, n and held | {"open": [*held["open"], self._put("open", new)], "rows": held["rows"] + n}, []

        return self._commit(change)

    def claim(self, worker: str, limit: int, now: float) -> DataFrame:
        """(id, at, batch, tries): the oldest open rows that nobody holds, now the worker's until its lease runs out. Rows that were given up are claimed no more."""

        def change(held, _):
            leases = self._of(held, "leases")
            barred = leases.where((F.col("until") > now) | (F.col("tries") >= self.tries)).select(KEY)
            free = self._open(held).join(barred, KEY, "left_anti").join(leases.select(*KEY, "tries"), KEY, "left").orderBy("at", "id").limit(limit)
            mine = settle(free.select("id", "at", "batch", (F.coalesce("tries", F.lit(0)) + 1).alias("tries"), F.lit(worker).alias("worker"), F.lit(now + self.lease).alias("until")))
            if mine.isEmpty():
                return mine, None, []
            return mine, held | {"leases": [self._put("leases", leases.join(mine.select(KEY), KEY, "left_anti").unionByName(mine))]}, held["leases"]

        return self._commit(change).select("id", "at", "batch", "tries")

    def done(self, worker: str, rows: DataFrame) -> int:
        """Close claimed rows (id, batch). Those that another worker holds by now are left to it. Returns how many were closed."""
        rows = settle(rows.select(KEY).distinct())

        def change(held, _):
            leases = self._of(held, "leases")
            own = settle(leases.where(F.col("worker") == worker).join(rows, KEY, "left_semi").select(KEY))
            n = own.count()
            if not n:
                return 0, None, []
            left = self._put("leases", leases.join(own, KEY, "left_anti"))
            new = held | {"leases": [left], "closed": [*held["closed"], self._put("closed", own)], "gone": held["gone"] + n}
            if 4 * new["gone"] < new["rows"]:
                return n, new, held["leases"]
            whole = self._put("open", self._open(new))
            return n, new | {"open": [whole], "closed": [], "rows": new["rows"] - new["gone"], "gone": 0}, held["leases"] + held["open"] + new["closed"]

        return self._commit(change)

    def release(self, worker: str, rows: DataFrame) -> None:
        """Give claimed rows (id, batch) back before their lease runs out; the claim counts as a try."""
        rows = settle(rows.select(*KEY, F.lit(True).alias("back")).distinct())

        def change(held, _):
            both = self._of(held, "leases").join(rows, KEY, "left")
            until = F.when(F.col("back") & (F.col("worker") == worker), 0.0).otherwise(F.col("until"))
            return None, held | {"leases": [self._put("leases", both.withColumn("until", until).drop("back"))]}, held["leases"]

        self._commit(change)

    # --- how ---------------------------------------------------------------------------------------------------------

    def _held(self) -> tuple[int, dict]:
        version, held = self.manifest.read()
        return version, held or {"open": [], "leases": [], "closed": [], "rows": 0, "gone": 0}

    def _of(self, held: dict, name: str) -> DataFrame:
        paths = [f"{self.root}/{p}" for p in held[name]]
        return self.spark.read.schema(SCHEMAS[name]).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMAS[name])

    def _open(self, held: dict) -> DataFrame:
        return self._of(held, "open").join(self._of(held, "closed"), KEY, "left_anti")

    def _put(self, name: str, rows: DataFrame) -> str:
        path = f"{name}/{uuid.uuid4().hex}"
        rows.select([f.name for f in self._of({name: []}, name).schema]).write.parquet(f"{self.root}/{path}")
        self.written.append(path)
        return path

    def _commit(self, change):
        """Commit what change(held, version) makes of the newest version, (result, new content or nothing, names it has no use for); once more if another
        worker came first. Files of the version that was read may be gone by then as well, which is no fault either."""
        while True:
            version, self.written = 0, []
            try:
                version, held = self._held()
                result, new, dead = change(held, version)
                if new:
                    self.manifest.commit(version, {k: v for k, v in new.items() if k != "dead"}, dead)
                return result
            except Exception as e:
                for path in self.written:
                    self.manifest.files.remove(path)
                if not isinstance(e, Conflict) and version == max(self.manifest.versions(), default=0):
                    raise


def hydrate_some(spark: SparkSession, root: str, queue: Queue, worker: str, pages: DataFrame, now: float, limit: int = 200, embedder: str = "local-hash", cfg: Settings = Settings()) -> dict:
    """One tick of a worker: claim links of the store at root whose pages are still to be read, index those whose page (id, html) has come, and close them.

    A link without a page goes back to be tried again; at its last try it keeps its title and leaves the queue, as one whose page can't be read. A worker that dies
    before it closes its rows is taken over from when its lease runs out: what it has indexed already is not pending any more, and is closed unread."""
    mine = queue.claim(worker, limit, now)
    here = pages.select("id").distinct()
    ready = settle(mine.join(here.withColumn("come", F.lit(True)), "id", "left").where(F.col("come") | (F.col("tries") >= queue.tries)).select(KEY))
    counts = {"fetched": 0, "indexed": 0, "failed": 0, "chunks": 0}
    while not ready.isEmpty():
        try:
            counts = Store(spark, root, embedder=embedder, cfg=cfg).hydrate(ready.select("id"), pages, now).first().asDict()
            break
        except Conflict:
            continue  # another worker has committed; the store is opened anew
    back = settle(mine.join(ready, KEY, "left_anti"))
    closed = queue.done(worker, ready)
    if not back.isEmpty():
        queue.release(worker, back)
    return counts | {"claimed": mine.count(), "closed": closed}
