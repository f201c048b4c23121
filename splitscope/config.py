"""Experiment registry and analysis thresholds.

Everything here is plan-time configuration: it is turned into literals inside
Spark expressions, never shipped as data.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from statistics import NormalDist

USER_FORWARD = "user_forward"
SESSION = "session"
SCOPES = (USER_FORWARD, SESSION)

BOTH = "both"
EXCLUDE = "exclude"
FIRST = "first"
CROSSOVERS = (BOTH, EXCLUDE, FIRST)


@dataclass(frozen=True)
class Arm:
    """One variant: its label, the URL fragment that identifies it, and the
    share of traffic it was meant to get (None: an equal split)."""

    variant: str
    url_contains: str
    share: float | None = None


@dataclass(frozen=True)
class Experiment:
    """An experiment. The first arm is the control; arms are tested in order,
    so a URL that fits two arms belongs to the earlier one."""

    experiment_id: str = "landing_page"
    arms: tuple[Arm, ...] = (
        Arm("Control_A", "/landing-v1"),
        Arm("Variant_B", "/landing-v2"),
    )

    def __post_init__(self) -> None:
        labels = [a.variant for a in self.arms]
        if len(labels) < 2 or len(set(labels)) != len(labels):
            raise ValueError("an experiment needs at least two distinct arms")
        shares = [self.share_of(a) for a in self.arms]
        if min(shares) <= 0 or abs(sum(shares) - 1) > 1e-9:
            raise ValueError("arm shares must be positive and add up to 1")

    @property
    def control(self) -> Arm:
        return self.arms[0]

    @property
    def treatments(self) -> tuple[Arm, ...]:
        return self.arms[1:]

    def share_of(self, arm: Arm) -> float:
        return 1.0 / len(self.arms) if arm.share is None else arm.share


# One experiment, or a registry of several. A registry adds an
# ``experiment_id`` column to every result; a single experiment does not.
Experiments = Experiment | Sequence[Experiment]

LANDING_PAGE = Experiment()


def as_registry(experiments: Experiments) -> tuple[Experiment, ...]:
    registry = (experiments,) if isinstance(experiments, Experiment) else tuple(experiments)
    ids = [e.experiment_id for e in registry]
    if not ids or len(set(ids)) != len(ids):
        raise ValueError("experiment ids must be present and distinct")
    return registry


def experiment_keys(experiments: Experiments) -> list[str]:
    """Grouping columns that identify an experiment in results."""
    return [] if isinstance(experiments, Experiment) else ["experiment_id"]


@dataclass(frozen=True)
class GuardrailLimits:
    """How much worse the variant may be before a guardrail fails."""

    bounce_pp: float = 5.0
    duration_ratio: float = 0.8
    cart_abandonment_pp: float = 10.0


@dataclass(frozen=True)
class PowerSettings:
    """Test size and power, with the matching normal quantiles."""

    alpha: float = 0.05
    power: float = 0.80
    z_alpha: float = 1.96
    z_beta: float = 0.84

    @classmethod
    def for_levels(cls, alpha: float, power: float) -> PowerSettings:
        """Settings whose quantiles follow from the levels (two-sided test)."""
        normal = NormalDist()
        return cls(alpha, power, normal.inv_cdf(1 - alpha / 2), normal.inv_cdf(power))
