"""Presets and fixed values of the memory model."""

from __future__ import annotations

from dataclasses import dataclass

HOUR_MS, DAY_MS = 3_600_000, 86_400_000


@dataclass(frozen=True)
class RetrievalConfig:
    """``core``: threshold 0.3 and noise 0.1; ``server``: 0.0 and 0.25."""

    threshold: float = 0.3
    noise: float = 0.1
    decay: float = 0.5
    depth: int = 3
    spread_decay: float = 0.7
    least_activation: float = 0.01
    backward: float = 0.5
    seeds: int = 5
    seed_floor: float = 0.1
    min_probability: float = 0.1
    limit: int = 10


CORE = RetrievalConfig()
SERVER = RetrievalConfig(threshold=0.0, noise=0.25)

#: Days after which an unreinforced association has decayed to 1/e, by state.
DECAY_DAYS = {"fresh": 1 / 24, "consolidating": 1.0, "consolidated": 30.0, "reconsolidating": 7.0}
#: Fixed values of working memory, noise, encoding and reconsolidation.
WORKING_MEMORY = {"capacity": 7, "decay_ms": 4000.0, "max_boost": 1.0, "expiry_ms": 20_000}
ENCODING = {"base": 0.3, "attention": 0.2, "emotion": 0.2, "rehearsal": 0.3, "most": 10}
NOISE_BASE = 0.25
RECONSOLIDATION = {"low": 0.10, "high": 0.55, "beta": 10.0}
EPISODE = {"gap_ms": 300_000, "most_events": 50, "reach": 10, "forward": 1.0, "backward": 0.7, "rate": 0.3, "boost": 1.2}
#: Importance from which a memory primes later ones, what it gives, how long, and the cells that the fold uses.
PRIMING = {"threshold": 0.7, "slope": 1.67, "most": 0.5, "half_life_ms": 5_400_000.0, "least": 0.01, "cell_ms": 43_200_000}
