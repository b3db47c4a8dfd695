"""The knobs of the engine. Defaults follow the published behaviour of the recall pipeline."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

#: Environment variable that names the embedding model.
MODEL_ENV = "MEMWEFT_MODEL"
#: Environment variable that names the recall log; ``off``, ``0`` or ``false`` disables it.
LOG_ENV = "MEMWEFT_LOG"
DEFAULT_MODEL = "signed-hash-384"


def cache_home() -> str:
    base = os.environ.get("XDG_CACHE_HOME") or os.path.expanduser("~/.cache")
    return os.path.join(base, "memweft")


@dataclass(frozen=True)
class RecallConfig:
    """All settings of one vault; immutable, so that it can be closed over by plans."""

    # The published names and defaults of the settings, down to the extensions.
    model: str = field(default_factory=lambda: os.environ.get(MODEL_ENV) or DEFAULT_MODEL)
    dim: int = 384
    chunk_chars: int = 1500
    rrf_k: int = 60
    vec_pool: int = 30
    fts_pool: int = 30
    half_life_days: float = 0.0  # 0: no decay
    mmr_lambda: float = 0.7  # 1: pure relevance
    snippet_chars: int = 0  # 0: the whole chunk
    db_dir: str = ""  # "": under the user's cache
    evergreen_re: str = r"^(MEMORY|INDEX|.*reference_|.*architecture).*"
    recursive: bool = False
    strip_frontmatter: bool = False
    ignore_globs: tuple[str, ...] = ()
    # extensions
    live_age: bool = False  # age from the stored mtime at query time instead of at index time
    min_score: float | None = None  # drop hits below this fused score
