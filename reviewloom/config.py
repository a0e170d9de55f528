"""Parameters of the batch jobs, with their published defaults; environment variables override those of the hybrid set."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class QueryConfig:
    variant: str = "medical"
    top_k: int = 10
    recommend_from: float = 4.0


@dataclass(frozen=True)
class EvalConfig:
    share: float = 0.20
    seed: int = 42
    min_rows: int = 5
    max_queries: int = 50
    ks: tuple[int, ...] = (1, 5, 10, 20)


@dataclass(frozen=True)
class SuiteConfig:
    top_k: int = 5
    top_terms: int = 8


@dataclass(frozen=True)
class StopwordConfig:
    min_ratio: float = 0.60
    min_df: int = 30
    min_len: int = 2
    top: int = 200
    min_entropy: float = 0.60


@dataclass(frozen=True)
class HybridConfig:
    conf_th_neg: float = 0.78
    conf_th_pos: float = 0.70
    conf_th_neu_info: float = 0.90
    conf_th_neu_mixed: float = 0.82
    gold_repeat: int = 3
    max_weak_per_class_mult: float = 6.0

    @classmethod
    def from_env(cls, prefix: str = "HYB_", env: dict[str, str] | None = None) -> HybridConfig:
        """The defaults, or what variables such as HYB_GOLD_REPEAT say."""
        env = os.environ if env is None else env
        kinds = {"float": float, "int": int}
        return cls(**{f.name: kinds[f.type](env[k]) for f in fields(cls) if (k := prefix + f.name.upper()) in env})


@dataclass(frozen=True)
class RequestConfig:
    max_items: int = 30
    max_chars: int = 12_000
    max_item_chars: int = 700
    retries: int = 3
    salvage_ratio: float = 0.25
