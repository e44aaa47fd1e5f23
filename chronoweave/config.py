"""Settings of all sections, with their defaults; unknown ones are errors."""

from __future__ import annotations

import json
from dataclasses import MISSING, asdict, dataclass, field, fields
from pathlib import Path


@dataclass
class Chunk:
    strategy: str = "fixed_size"
    chunk_size: int = 1500
    chunk_overlap: int = 100
    max_sentences: int = 10
    sentence_overlap: int = 2
    min_chunk_size: int = 500
    max_chunk_size: int = 2000
    preserve_sentences: bool = True


@dataclass
class Extract:
    enable_multi_round: bool = True
    max_rounds: int = 2
    prior_events_context_mode: str = "none"
    prior_events_window_size: int = 3


@dataclass
class Disambiguate:
    similarity_threshold: float = 0.85
    canonical_name_weight: float = 2.0


@dataclass
class TimelineSettings:
    enable_iterative: bool = False
    iterative_batch_size: int = 20
    max_context_timelines: int = 50


@dataclass
class Retrieve:
    top_k: int = 10
    fuzzy_match: bool = True
    case_sensitive: bool = False
    similarity_threshold: float = 0.5
    keyword_algorithm: str = "bm25"
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    min_keyword_length: int = 2
    vector_metric: str = "cosine"
    keyword_weight: float = 0.3
    semantic_weight: float = 0.7
    fusion_mode: str = "rrf"
    rrf_k: int = 60
    enable_keyword: bool = True
    enable_semantic: bool = True


@dataclass
class Vote:
    entity_weight: float = 0.25
    timeline_weight: float = 0.30
    event_weight: float = 0.45
    entity_decay: float = 0.7
    timeline_decay: float = 0.9
    fusion_mode: str = "rrf"
    rrf_k: int = 60
    min_votes: int = 1
    min_score: float = 0.0
    multiplier: float = 2.0
    alpha: float = 0.3
    beta: float = 0.7


@dataclass
class Hierarchy:
    k1: int = 5
    k2: int = 10
    k3: int = 20
    entity_threshold: float = 0.0
    timeline_threshold: float = 0.0
    event_threshold: float = 0.0


@dataclass
class Config:
    chunk: Chunk = field(default_factory=Chunk)
    extractor: Extract = field(default_factory=Extract)
    disambiguator: Disambiguate = field(default_factory=Disambiguate)
    timeline: TimelineSettings = field(default_factory=TimelineSettings)
    retriever: Retrieve = field(default_factory=Retrieve)
    voting: Vote = field(default_factory=Vote)
    hierarchical: Hierarchy = field(default_factory=Hierarchy)
    event_filter_enabled: bool = True
    event_validator_enabled: bool = True
    data_dir: str = "data"

    @classmethod
    def from_dict(cls, data: dict) -> Config:
        kinds = {f.name: f.default_factory for f in fields(cls) if f.default_factory is not MISSING}
        return cls(**{k: kinds[k](**v) if k in kinds else v for k, v in data.items()})

    @classmethod
    def load(cls, path: str | None = None) -> Config:
        """Defaults where there is no file."""
        return cls.from_dict(json.loads(Path(path).read_text())) if path and Path(path).exists() else cls()

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=2))


#: Settings that suit short factual texts.
COMPACT = {"chunk": {"chunk_size": 200, "chunk_overlap": 50, "min_chunk_size": 50, "preserve_sentences": False}, "disambiguator": {"similarity_threshold": 0.8, "canonical_name_weight": 10.0}, "event_filter_enabled": False, "voting": {"entity_decay": 0.85, "timeline_decay": 0.95, "alpha": 0.25, "beta": 0.75}, "hierarchical": {"k1": 3, "k2": 5, "k3": 10}}
