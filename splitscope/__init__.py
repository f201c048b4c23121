"""Web-experiment analytics on Spark DataFrames."""

from splitscope.config import (
    LANDING_PAGE,
    Arm,
    Experiment,
    GuardrailLimits,
    PowerSettings,
)
from splitscope.plans.study import Study

__all__ = [
    "LANDING_PAGE",
    "Arm",
    "Experiment",
    "GuardrailLimits",
    "PowerSettings",
    "Study",
]
