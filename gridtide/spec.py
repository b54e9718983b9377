"""What a panel is: its key, clock, bounds, horizons and splits."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime


@dataclass(frozen=True)
class PanelSpec:
    """An hourly panel of one count per key.

    Bounds and splits are half-open ranges of local wall-clock time in ``tz``. A forecast run may be used
    from ``lag_hours`` after it starts; runs start every ``cycle_hours``.
    """

    tz: str
    start: datetime
    end: datetime
    horizons: tuple[int, ...] = (1, 3, 6)
    lag_hours: int = 6
    cycle_hours: int = 6
    splits: tuple[tuple[str, datetime, datetime], ...] = ()

    def __post_init__(self) -> None:
        if self.start >= self.end:
            raise ValueError("start must be before end")
        # A local day can be 23 hours long: the same hour of the day before is then only 23 hours back.
        if not self.horizons or min(self.horizons) < 1 or max(self.horizons) > 23:
            raise ValueError("horizons must be 1 to 23 hours")


@dataclass(frozen=True)
class FeatureContract:
    """Columns that a model may see, and the column it predicts."""

    name: str
    categorical: tuple[str, ...]
    numeric: tuple[str, ...]
    target: str = "demand"

    def __post_init__(self) -> None:
        if self.target in self.columns:
            raise ValueError("the target is among the features")
        if len(set(self.columns)) != len(self.columns):
            raise ValueError("a column is named twice")

    @property
    def columns(self) -> tuple[str, ...]:
        return self.categorical + self.numeric

    def extended(self, name: str, categorical: tuple[str, ...] = (), numeric: tuple[str, ...] = ()) -> FeatureContract:
        return FeatureContract(name, self.categorical + categorical, self.numeric + numeric, self.target)


HISTORY_COLUMNS = ("demand_at_cutoff", "demand_1h_before", "demand_2h_before", "mean_3h", "mean_6h", "mean_24h", "std_24h", "demand_day_before", "demand_week_before")
CALENDAR_COLUMNS = ("local_hour", "local_weekday", "local_weekend", "local_month")

CONTRACT_A = FeatureContract("A", ("key", "local_hour", "local_weekday", "local_month", "local_weekend"), HISTORY_COLUMNS)
CONTRACT_B = CONTRACT_A.extended("B", numeric=("forecast_value", "forecast_k"))
