"""Thresholds and limits of the entry points, with their defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class ResolveConfig:
    """Incremental resolution."""

    match: float = 1.00
    uncertain: float = 1.15
    coherence: float = 1.10
    min_px: float = 50
    min_score: float = 0.6
    min_person_photos: int = 3
    quorum: int = 3
    recluster_every: int = 0
    #: Off as by default: merging identities then looks at distances alone, not at shared groups.
    enforce_exclusion: bool = False


@dataclass(frozen=True)
class RankConfig:
    """Global ranking."""

    block: int = 4000
    level1: float = 1.00
    level2: float = 1.10
    level3: float = 1.00
    quorum: int = 3
    min_px: float = 50
    min_score: float = 0.70
    top: int = 20
    blocked: float = 1.10


@dataclass(frozen=True)
class BatchConfig:
    """Batches of files."""

    max_bytes: int = 1_000_000_000
    max_items: int = 250
    album_batch: int = 50
    #: Items that one clustering kernel takes: its matrices are about 1.1 GB each there.
    max_kernel_items: int = 12_000
    #: Items of a component that one task links without a matrix; a larger component is merged in rounds over tiles.
    max_linked_items: int = 250_000


@dataclass(frozen=True)
class SweepConfig:
    """The full sweep: what a cycle fetches at most, which files it keeps, and how often all identities are made anew."""

    max_size_mb: int = 3000
    keep_ext: tuple[str, ...] = (".jpg", ".jpeg", ".heic", ".heif")
    recluster_every: int = 10

    @classmethod
    def from_environment(cls, prefix: str = "SEMBLANCE_SWEEP_") -> SweepConfig:
        """Defaults, replaced by what the environment sets: <prefix>MAX_SIZE_MB, KEEP_EXT (with commas), RECLUSTER_EVERY."""
        get = lambda name, read, default: read(os.environ[prefix + name]) if prefix + name in os.environ else default
        extensions = lambda text: tuple(x.strip() for x in text.split(",") if x.strip())
        return cls(get("MAX_SIZE_MB", int, cls.max_size_mb), get("KEEP_EXT", extensions, cls.keep_ext), get("RECLUSTER_EVERY", int, cls.recluster_every))

    def resolving(self, cfg: ResolveConfig = ResolveConfig()) -> ResolveConfig:
        return replace(cfg, recluster_every=self.recluster_every)
