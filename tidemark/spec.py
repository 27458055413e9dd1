"""What a user says about a table: which columns are dimensions, time and feature."""

from __future__ import annotations

from dataclasses import dataclass, replace


def parse_groups(groups) -> tuple[str, ...]:
    """Dimension columns from a list, or from text such as ``"store+city"``."""
    if groups is None or groups in ("", "None", "none", "null"):
        return ()
    if isinstance(groups, str):
        groups = groups.split("+")
    return tuple(g for g in groups if g not in (None, "", "None", "none", "null"))


@dataclass(frozen=True)
class SeriesSpec:
    """Names of the columns that make up the series of a table.

    ``groups`` may be empty: the whole table is then one series. ``tie`` orders
    rows that share a time and identifies rows when rows are drawn by hash.
    """

    time: str
    feature: str
    groups: tuple[str, ...] = ()
    tie: tuple[str, ...] = ()

    def __post_init__(self):
        object.__setattr__(self, "groups", parse_groups(self.groups))
        tie = (self.tie,) if isinstance(self.tie, str) else tuple(self.tie)
        object.__setattr__(self, "tie", tie)

    @property
    def order(self) -> list[str]:
        return [self.time, *[c for c in self.tie if c != self.time]]

    def with_groups(self, groups) -> "SeriesSpec":
        return replace(self, groups=tuple(groups))

    def with_feature(self, feature: str) -> "SeriesSpec":
        return replace(self, feature=feature)
