"""Settings of the engine, with defaults; the environment may set each as SILTSTONE_ and its name in capitals."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    chunk_words: int = 512
    chunk_overlap_words: int = 64
    embed_batch: int = 16
    top_k_default: int = 5
    top_k_max: int = 10
    query_max_chars: int = 500
    rate_limit_per_hour: int = 60
    exclude_repos: str = ""
    extra_files: str = ""
    summary_seconds: int = 3_600

    @classmethod
    def from_environment(cls) -> Settings:
        """A value that isn't of its field's type raises, and names the setting."""
        given = {}
        for f in fields(cls):
            raw = os.environ.get(f"SILTSTONE_{f.name.upper()}")
            if raw is not None:
                try:
                    given[f.name] = int(raw) if isinstance(f.default, int) else raw
                except ValueError:
                    raise ValueError(f"SILTSTONE_{f.name.upper()}: {raw!r} is no number") from None
        return cls(**given)
