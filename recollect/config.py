"""Settings; the defaults decide results."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # passages
    chunk_chars: int = 420
    overlap_chars: int = 80
    max_seconds: float = 90.0
    comment_chars: int = 600
    min_passage: int = 8
    # retrieval
    top_chunks: int = 40
    top_items: int = 5
    chunks_per_item: int = 4
    dense_weight: float = 0.6
    lexical_weight: float = 0.4
    rrf_k: int = 60
    k1: float = 1.4
    b: float = 0.72
    max_df_ratio: float = 0.35
    min_confidence: float = 0.30
    min_score_ratio: float = 0.45
    # context queries
    min_library_items: int = 15
    exclude_digested: bool = True
    exclude_self: bool = True
    # comments
    comments: int = 15
    comment_likes: int = 3
    comment_min_chars: int = 15
    replies: int = 2
    # embedding
    dimensions: int = 512
    #: Passages of an index from which on a search finds out first which of its zones can matter. In small ones that costs more than it saves.
    prune_from: int = 2_000_000
    #: Queries up to which it does so: of many, nearly every zone matters to some, and a row for each pair of zone and query costs more than adding up.
    prune_queries: int = 16
    #: Rows up to which a side of a join is broadcast; beyond, the join shuffles.
    broadcast_rows: int = 200_000
    #: The same of a side that is one number a row.
    broadcast_numbers: int = 2_000_000

    def pool(self, limit: int) -> int:
        return max(4 * limit, 64)


#: How much a passage counts by what it is; other kinds count 1.
KIND_WEIGHTS = {"title": 1.06, "transcript": 1.0, "comment": 0.95, "description": 0.92}
