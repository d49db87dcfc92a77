"""Standing, tiers and sampling as column expressions. Standings lie in [-128, 0]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lowest standing, lower edges of tiers 0..3 and sampling shares of tiers 0..4.
FLOOR = -128
TIER_EDGES = [0, -8, -31, -63]
TIER_NAMES = ["Pristine", "Watch", "Suspect", "Suspended", "Banned"]
TIER_SHARES = [0.02, 0.10, 0.25, 1.0, 1.0]
SHARE_FLOOR = 0.02
#: What a verdict adds to a standing.
VERDICT_DELTAS = {"Ok": 1, "FidelityBelowThreshold": -8, "IntegrityViolation": -32, "CommitmentMismatch": -64, "Inconclusive": 0}
COARSE_DELTAS = {"Timeout": -4, "VerificationFailure": -8}


def pick(key: Column, table: dict) -> Column:
    out = F.lit(None)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def clamp(standing: Column) -> Column:
    return F.greatest(F.lit(FLOOR), F.least(F.lit(0), standing))


def tier_of(standing: Column) -> Column:
    """Tier ordinal 0 (pristine) to 4 (banned)."""
    out = F.lit(len(TIER_EDGES))
    for k in reversed(range(len(TIER_EDGES))):
        out = F.when(standing >= TIER_EDGES[k], F.lit(k)).otherwise(out)
    return out


def tier_name(tier: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, TIER_NAMES)), tier + 1)


def eligible(tier: Column) -> Column:
    return tier < 3


def share_for(tier: Column) -> Column:
    return F.greatest(F.element_at(F.array(*map(F.lit, TIER_SHARES)), tier + 1), F.lit(SHARE_FLOOR))


def challenge_count(share: Column, n: Column) -> Column:
    """ceil(share * n) within 0..n; a share that is no positive number gives 0."""
    bad = share.isNull() | F.isnan(share) | (share <= 0)
    return F.when(bad, F.lit(0).cast("long")).otherwise(F.least(n, F.greatest(F.lit(0).cast("long"), F.ceil(share * n))))


def verdict_delta(detail: Column) -> Column:
    return pick(detail, VERDICT_DELTAS)


def coarse_delta(delta: Column) -> Column:
    return pick(delta, COARSE_DELTAS)


def after_verdict(standing: Column, detail: Column) -> Column:
    return clamp(standing + verdict_delta(detail))
