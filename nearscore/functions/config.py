"""Constants of the scoring model, as text, and their JSON forms."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields

# They must equal the published ones for right scores.

#: Features in the engine's order.
FEATURES = (
    "km_from_last_tx", "card_present", "is_online", "minutes_since_last_tx", "unknown_merchant", "amount_vs_avg", "day_of_week",
    "km_from_home", "amount", "installments", "tx_count_24h", "mcc_risk", "hour_of_day", "merchant_avg_amount",
)
#: Features in the order of reference files.
FILE_ORDER = (
    "amount", "installments", "amount_vs_avg", "hour_of_day", "day_of_week", "minutes_since_last_tx", "km_from_last_tx",
    "km_from_home", "tx_count_24h", "is_online", "card_present", "unknown_merchant", "mcc_risk", "merchant_avg_amount",
)
#: Risk of merchant category codes; any other code has MCC_DEFAULT.
MCC_RISK = {"5411": 0.15, "5812": 0.30, "5912": 0.20, "5944": 0.45, "7801": 0.80, "7802": 0.75, "7995": 0.85, "4511": 0.35, "5311": 0.25, "5999": 0.50}
MCC_DEFAULT = 0.50
#: Dimensions, neighbours that vote, candidates before the rerank, votes that reject, steps of quantisation per unit.
DIMS, NEIGHBOURS, CANDIDATES, REJECT_AT, SCALE = len(FEATURES), 5, 10, 3, 4096
#: Known merchants that count, and bytes of the longest payload.
MOST_MERCHANTS, MOST_PAYLOAD = 32, 4096

#: For each feature in the engine's order, its place in a reference file's vector.
DIM_ORDER = tuple(FILE_ORDER.index(f) for f in FEATURES)


@dataclass(frozen=True)
class Normalization:
    """What features are divided by; every value has to be above zero."""

    max_amount: float = 10000.0
    max_installments: float = 12.0
    amount_vs_avg_ratio: float = 10.0
    max_minutes: float = 1440.0
    max_km: float = 1000.0
    max_tx_count_24h: float = 20.0
    max_merchant_avg_amount: float = 10000.0

    def __post_init__(self):
        if bad := [k for k, v in asdict(self).items() if not v > 0]:
            raise ValueError(f"normalization values must be above zero: {', '.join(bad)}")

    @classmethod
    def from_json(cls, text: str) -> Normalization:
        """Keys that are missing or no number keep their defaults; others are ignored."""
        given = json.loads(text)
        return cls(**{f.name: float(given[f.name]) for f in fields(cls) if isinstance(given.get(f.name), (int, float)) and not isinstance(given[f.name], bool)})


def mcc_from_json(text: str) -> dict[str, float]:
    """Codes are whole numbers from 0 to 9999, risks are numbers; entries of another kind are skipped."""
    return {str(int(k)): float(v) for k, v in json.loads(text).items() if k.isdigit() and int(k) < 10000 and isinstance(v, (int, float)) and not isinstance(v, bool)}


@dataclass(frozen=True)
class ScoringConfig:
    norm: Normalization = field(default_factory=Normalization)
    mcc_risk: dict[str, float] = field(default_factory=lambda: dict(MCC_RISK))
