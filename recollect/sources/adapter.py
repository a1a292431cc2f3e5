"""Sources of saved things behind one interface: what is saved, its transcript, its comments, and whose a URL is."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import canonical_url, identify
from .files import READERS, as_items, first_of_each


class SourceAdapter(ABC):
    """A source. Tables come and go, never single items, so that a fetch is a job over all items at once."""

    #: What every item's source column says.
    name = "base"

    @abstractmethod
    def list_saved(self, spark: SparkSession, limit: int | None = None) -> DataFrame:
        """The saved items as plans.ingest takes them, idx giving their order; at most limit of the first."""

    def fetch_content(self, items: DataFrame) -> DataFrame | None:
        """(id, segments) of items; None: this source has no transcripts."""
        return None

    def fetch_comments(self, items: DataFrame) -> DataFrame | None:
        """(id, comments) of items; None: this source has no comments."""
        return None

    def parse_url(self, url: Column) -> Column:
        """The id that a URL has in this source; empty if it is another's."""
        who = identify(canonical_url(url))
        return F.when(who["source"] == self.name, who["source_id"]).otherwise("")


class FileAdapter(SourceAdapter):
    """Files of saved things (jsonl, json, csv, txt); transcripts and comments lie in the rows themselves."""

    def __init__(self, path: str, kind: str, name: str = "local", now: float = 0.0):
        self.path, self.kind, self.name, self.now = path, kind, name, now

    def list_saved(self, spark: SparkSession, limit: int | None = None) -> DataFrame:
        rows = first_of_each(as_items(READERS[self.kind](spark, self.path), self.name, now=self.now))
        return rows.orderBy("idx").limit(limit) if limit else rows

    def fetch_content(self, items: DataFrame) -> DataFrame:
        return items.select("id", "segments")

    def fetch_comments(self, items: DataFrame) -> DataFrame:
        return items.select("id", "comments")


class TableAdapter(SourceAdapter):
    """Items from a table that a projection of captured payloads gives (sources/payloads.py), with tables of transcripts and comments."""

    def __init__(self, name: str, items: DataFrame, segments: DataFrame | None = None, comments: DataFrame | None = None):
        self.name, self.items, self.segments, self.comments = name, items, segments, comments

    def list_saved(self, spark: SparkSession, limit: int | None = None) -> DataFrame:
        return self.items.orderBy("idx").limit(limit) if limit else self.items

    def fetch_content(self, items: DataFrame) -> DataFrame | None:
        return self.segments.join(items.select("id"), "id", "left_semi") if self.segments is not None else None

    def fetch_comments(self, items: DataFrame) -> DataFrame | None:
        return self.comments.join(items.select("id"), "id", "left_semi") if self.comments is not None else None
