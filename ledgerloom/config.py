"""All tunables of retrieval in one place."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from typing import TypeVar

T = TypeVar("T")


def from_environment(kind: type[T], environment: Mapping[str, str] | None = None, prefix: str = "LEDGERLOOM") -> T:
    """A config with the fields that the environment sets as PREFIX_FIELD, in the fields' own types; others keep their
    defaults. What doesn't parse is an error that names the variable."""
    env, base, out = os.environ if environment is None else environment, kind(), {}
    for f in fields(kind):
        name, now = f"{prefix}_{f.name.upper()}", getattr(base, f.name)
        if name not in env or isinstance(now, dict):
            continue
        try:
            out[f.name] = env[name].strip().lower() in ("1", "true", "yes", "on") if isinstance(now, bool) else type(now)(env[name].strip())
        except ValueError as wrong:
            raise ValueError(f"{name}: {wrong}") from wrong
    return kind(**out)


@dataclass(frozen=True)
class SearchConfig:
    top_k: int = 5
    candidate_k: int = 50
    per_source_limit: int = 0
    rrf_k: int = 60
    dense_weight: float = 1.0
    bm25_weight: float = 1.0
    freshness_weight: float = 0.15
    authority_weight: float = 0.05
    rule_weight: float = 1.0
    decay_days: float = 180.0
    as_of: str = "2026-01-01"
    k1: float = 1.2
    b: float = 0.75
    idf_floor: float = 1e-6
    filters: dict[str, object] = field(default_factory=dict)

    def source_limit(self) -> int:
        if self.per_source_limit > 0:
            return self.per_source_limit
        return max(self.top_k, 8) if all(self.filters.get(k) for k in ("code", "year", "report_type")) else 2

    def dense_limit(self) -> int:
        return max(self.top_k * max(1, self.source_limit()) * 4, self.candidate_k)

    def sparse_limit(self) -> int:
        return max(self.candidate_k, self.top_k * 6)


@dataclass(frozen=True)
class ContextConfig:
    token_budget: int = 5000
    chars_a_token: int = 4
    least_chars: int = 3000
    snippet_chars: int = 900
    top_evidence: int = 8


@dataclass(frozen=True)
class ChunkConfig:
    report_chars: int = 1400
    announcement_chars: int = 2600
    overlap: int = 180
    announcement_chunks: int = 5
    least_part: int = 60
    least_paragraph: int = 30

    def __post_init__(self):
        if not self.overlap < 0.55 * min(self.report_chars, self.announcement_chars):
            raise ValueError("overlap must be under 0.55 of a chunk, or cutting doesn't advance")


@dataclass(frozen=True)
class MultistageConfig:
    documents: int = 8
    chunks_a_question: int = 6
