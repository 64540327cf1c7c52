"""Simulation settings, from TOML."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field

STRATEGIES = ("UnilateralSpender", "Consolidator", "BatchSpender", "MultipartyStrategy", "AggregatorStrategy")
#: Weight units of an input and of an output, and whether the input has a witness, by script type.
WEIGHTS = {"p2tr": (230, 172, True), "p2wpkh": (272, 124, True), "p2pkh": (592, 136, False)}


@dataclass(frozen=True)
class Scorer:
    privacy_weight: float = 0.0
    payment_obligation_weight: float = 1.0
    min_fallback_plans: int = 0


@dataclass(frozen=True)
class WalletType:
    name: str
    count: int
    strategies: tuple[str, ...]
    scorer: Scorer = field(default_factory=Scorer)
    script_type: str = "p2tr"


@dataclass(frozen=True)
class Config:
    max_timestep: int
    num_payment_obligations: int
    wallet_types: tuple[WalletType, ...]
    seed: int = 0


def parse(text: str) -> Config:
    """A Config; raises ValueError for unknown strategies or script types and for counts under 1."""
    raw = tomllib.loads(text)
    types = []
    for t in raw["wallet_types"]:
        unknown = [s for s in t["strategies"] if s not in STRATEGIES]
        if unknown:
            raise ValueError(f"unknown strategy: {unknown[0]}")
        if t["count"] < 1:
            raise ValueError(f"{t['name']}: count must be 1 or more")
        if t.get("script_type", "p2tr") not in WEIGHTS:
            raise ValueError(f"unknown script type: {t['script_type']}")
        types.append(WalletType(t["name"], t["count"], tuple(t["strategies"]), Scorer(**t["scorer"]), t.get("script_type", "p2tr")))
    s = raw["simulation"]
    return Config(s["max_timestep"], s["num_payment_obligations"], tuple(types), s.get("seed", 0))
