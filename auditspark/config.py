"""Parameters of the audit, in one place, hashed into what is written.

The numbers are fixed values: results depend on them.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

DAY = 86400


@dataclass(frozen=True)
class AuditConfig:
    seeds: tuple[int, ...] = (0, 1, 2, 3, 4)
    fold_days: int = 30
    min_train_days: int = 60
    latency_days: tuple[int, ...] = (0, 7, 30, 60, 120)
    headline_latency: int = 30
    strict_latency: int = 120
    uid_variant: str = "medium"
    agreement_threshold: float = 0.55
    agreement_weights: dict[str, float] = field(
        default_factory=lambda: {
            "card2": 1.0,
            "card3": 0.6,
            "card5": 0.6,
            "card6": 0.4,
            "card4": 0.4,
            "P_emaildomain": 1.2,
            "dist1": 0.5,
            "DeviceInfo": 1.4,
            "id_30": 0.8,
            "id_31": 0.8,
            "id_33": 1.0,
        }
    )
    risk_attributes: tuple[str, ...] = (
        "card1", "card2", "addr1", "P_emaildomain", "R_emaildomain",
        "DeviceInfo", "id_31", "id_33", "ProductCD_card4", "bin_proxy",
    )
    tau_days: float = 30.0
    blend: float = 0.4
    prior_min_count: int = 30
    regime_min_support: float = 0.005
    regime_max_count: int = 60
    miss_cost: float = 20.0
    budget: float = 0.01
    fold_min_test: int = 50
    fold_min_train: int = 200
    fold_min_positives: int = 5
    velocity_cap: int = 64

    def digest(self) -> str:
        """Of every field, so that two configurations never share a checkpoint."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, default=str).encode()).hexdigest()[:16]


CONFIG = AuditConfig()

UID_RECIPES: dict[str, tuple[str, ...]] = {
    "loose": ("card1", "D1n"),
    "medium": ("card1", "addr1", "D1n"),
    "strict": ("card1", "addr1", "card2", "card5", "D1n"),
}


@dataclass(frozen=True)
class Rung:
    """One step of the leakage ladder: which channels are still open.

    ``resample``: "before" the split, "inside" folds, or "none".
    """

    key: str
    label: str
    random_split: bool
    resample: str
    entity_disjoint: bool
    latency: int
    past_only: bool


LADDER = (
    Rung("rung0", "All leaks open (random split, resampling before the split)", True, "before", False, 0, False),
    Rung("rung1", "No resampling across the split", True, "none", False, 0, False),
    Rung("rung2", "Chronological split, past-only encodings", False, "none", False, 0, True),
    Rung("rung3", "Entity-disjoint train and test", False, "none", True, 0, True),
    Rung("rung4", "Only labels that have matured", False, "none", True, 30, True),
)

ABLATIONS: dict[str, tuple[str, ...]] = {
    "full": (),
    "no_riskB": ("association_risk",),
    "no_regimesC": ("missingness",),
    "no_entity_memory": ("entity_memory",),
    "no_monotoneD": (),
    "behaviour_only": ("association_risk", "missingness", "entity_memory"),
}

#: Ablations whose monotone model is fitted without its constraints.
UNCONSTRAINED = ("no_monotoneD", "behaviour_only")
