"""Which files make up a stored thing: one small JSON file for each version, so that all its tables change at once or not at all."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has committed that version first."""


class Files:
    """What is needed of a folder, on whatever file system it lies."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str = "") -> list[str]:
        at = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def text(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> bool:
        """Write a file that appears whole or not at all; False if there is one of that name."""
        draft = self.path(f"{name}.{uuid.uuid4().hex}.tmp")
        stream = self.fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        won = not self.fs.exists(self.path(name)) and self.fs.rename(draft, self.path(name))
        if not won:
            self.fs.delete(draft, False)
        return won

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class Manifest:
    """The versions of a root. A version is a dict of its own making; "dead" in it are names under the root that it has no use for any more.

    What a version makes dead is removed when the next one is committed: whoever holds the version before it still finds its
    files, and a run that dies between writing and committing leaves the last version as it was. (Names that such a run has left are in no version;
    see orphans().) A rename that refuses existing names, as HDFS has it, keeps two writers from committing the same version."""

    FOLDER, WIDTH = "_versions", 12

    def __init__(self, spark: SparkSession, root: str):
        self.files, self.root = Files(spark, root), root

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names(self.FOLDER) if n.endswith(".json")]

    def read(self, version: int | None = None) -> tuple[int, dict]:
        """(number, content) of a version, the newest if none is named; (0, {}) before the first."""
        if version is None:
            version = max(self.versions(), default=0)
        return version, json.loads(self.files.text(f"{self.FOLDER}/{version:0{self.WIDTH}}.json")) if version else {}

    def commit(self, after: int, content: dict, dead: list[str] = ()) -> int:
        """Make content the version that follows after; raises Conflict if after is not the newest."""
        if after != max(self.versions(), default=0) or not self.files.put(f"{self.FOLDER}/{after + 1:0{self.WIDTH}}.json", json.dumps(content | {"dead": sorted(dead)})):
            raise Conflict(f"{self.root}: version {after + 1} exists")
        if after:
            for name in self.read(after)[1].get("dead", []):
                self.files.remove(name)
            for old in [v for v in self.versions() if v < after]:
                self.files.remove(f"{self.FOLDER}/{old:0{self.WIDTH}}.json")
        return after + 1

    def orphans(self, used: set[str], folders: tuple[str, ...] = ("",)) -> list[str]:
        """Names under the root's folders that no version that is still there uses: what runs that died have left. Only for a root that nobody is
        writing to."""
        held = set(used)
        for v in self.versions():
            held |= set(self.read(v)[1].get("dead", []))
        every = [f"{f}/{n}" if f else n for f in folders for n in self.files.names(f)]
        return [n for n in every if n not in held and n.split("/")[0] != self.FOLDER and n not in folders]
