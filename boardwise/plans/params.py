"""Checked parameters of reports."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

#: Board ratings by moment: (player column, pair column), each with {} for the seat or side. Players have no expected rating.
MOMENTS = {
    "Current Rating (End of Session)": ("Elo_R_{}", "Elo_R_{}"),
    "Rating at Start of Session": ("Elo_R_{}_Before", "Elo_R_{}_Before"),
    "Rating at Event Start": ("Elo_R_{}_EventStart", "Elo_R_{}_EventStart"),
    "Rating at Event End": ("Elo_R_{}_EventEnd", "Elo_R_{}_EventEnd"),
    "Expected Rating": (None, "Elo_E_Pair_{}"),
}
GATE_OFF = -90.0


@dataclass(frozen=True)
class Report:
    event: str = "club"
    entity: str = "Players"
    top_n: int = 100
    min_sessions: int = 10
    method: str = "Latest"
    moving_avg_days: int = 10  # accepted and echoed; no report uses it
    moment: str = "Current Rating (End of Session)"
    date_from: dt.datetime | None = None
    mode: str = "All"
    strata: str = "Open (unlimited)"
    prior_sessions: int = 50
    min_skill_z: float = 0.5

    def __post_init__(self) -> None:
        ranges = {"top_n": (1, 5000), "min_sessions": (1, 10_000), "moving_avg_days": (1, 3650), "prior_sessions": (0, 1000), "min_skill_z": (-100, 5)}
        for name, (low, high) in ranges.items():
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must be from {low} to {high}")
        choices = {"event": ("club", "tournament"), "entity": ("Players", "Pairs"), "method": ("Latest", "Avg", "Max"), "mode": ("All", "Local Only", "Online Only"), "moment": tuple(MOMENTS)}
        for name, known in choices.items():
            if getattr(self, name) not in known:
                raise ValueError(f"{name} must be one of {known}")
        if self.column is None:
            raise ValueError("players have no expected rating")

    @property
    def column(self) -> str | None:
        return MOMENTS[self.moment][self.entity == "Pairs"]

    @property
    def gate(self) -> float | None:
        return None if self.min_skill_z <= GATE_OFF else self.min_skill_z


def coerced(value: str | None, default: int, low: int, high: int, step: int = 1) -> int:
    """An integer parameter from text: default if it is none, else within bounds and on a step from the lower one."""
    try:
        n = int(float(value))  # type: ignore[arg-type]
    except (TypeError, ValueError, OverflowError):
        return default
    return min(high, low + round((min(high, max(low, n)) - low) / step) * step)
