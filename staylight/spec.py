"""What an analysis needs to know about a table: one frozen description per table.

Every operator takes a :class:`PanelSpec` and finds its columns, domains and limits there.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from types import MappingProxyType


def _frozen(mapping) -> Mapping:
    return MappingProxyType(dict(mapping))


@dataclass(frozen=True)
class Roles:
    """Which columns play the parts the derived features are computed from."""

    level: str
    income: str
    years_here: str
    since_change: str
    total_years: str
    job: str
    age: str
    group: str


@dataclass(frozen=True)
class Derived:
    """Names of the columns :func:`staylight.operators.features.engineer` adds."""

    share: str
    gap: str
    pay: str
    band: str


@dataclass(frozen=True)
class RateClaim:
    """A headline that holds when one category's rate exceeds another's.

    ``detail`` takes two ``%s``: the worse and the better rate as whole percents.
    """

    title: str
    field: str
    worse: str
    better: str
    detail: str


@dataclass(frozen=True)
class MoneyClaim:
    """A headline about pay; ``kind`` is ``pay_gap`` (conditional) or ``cost`` (always)."""

    title: str
    kind: str
    detail: str


@dataclass(frozen=True)
class PanelSpec:
    """One table of entities with a yes/no outcome."""

    name: str
    entity_id: str
    target: str
    #: Kept for fairness monitoring; never a feature, a segment or an action.
    monitor_only: tuple[str, ...]
    #: Input categoricals and their allowed values; an empty tuple allows any value.
    categoricals: Mapping[str, tuple[str, ...]]
    numerics: tuple[str, ...]
    #: Column that plays the part of monthly pay in reports and costs.
    income: str
    ranges: Mapping[str, tuple[float, float]] = field(default_factory=dict)
    whole_numbers: frozenset[str] = frozenset()
    defaults: Mapping[str, object] = field(default_factory=dict)
    roles: Roles | None = None
    derived: Derived | None = None
    #: Ascending (upper edge, label) pairs, then the label of everything above.
    tenure_edges: tuple[tuple[float, str], ...] = ()
    tenure_top: str = ""
    level_ranks: Mapping[str, int] = field(default_factory=dict)
    orderings: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    breakdowns: Mapping[str, str] = field(default_factory=dict)
    #: Values from worst to best, per field a plan may touch.
    ladders: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    playbook: Mapping[str, str] = field(default_factory=dict)
    pay_pitch: str = ""
    labels: Mapping[str, str] = field(default_factory=dict)
    claims: tuple[RateClaim | MoneyClaim, ...] = ()

    def __post_init__(self):
        for name in (
            "categoricals", "ranges", "defaults", "level_ranks", "orderings",
            "breakdowns", "ladders", "playbook", "labels",
        ):
            object.__setattr__(self, name, _frozen(getattr(self, name)))
        reachable = {*self.categoricals, *self.numerics, *self.ladders, *self.playbook}
        leaked = sorted(reachable & set(self.monitor_only))
        if leaked:
            raise ValueError(f"monitor-only columns cannot be features or actions: {leaked}")

    @property
    def form_fields(self) -> tuple[str, ...]:
        return tuple(self.categoricals)

    @property
    def contract(self) -> tuple[str, ...]:
        """Columns a scoring input must have."""
        return (*self.categoricals, *self.numerics)

    @property
    def model_categoricals(self) -> tuple[str, ...]:
        band = (self.derived.band,) if self.derived else ()
        return (*self.categoricals, *band)

    @property
    def model_numerics(self) -> tuple[str, ...]:
        if self.derived is None:
            return self.numerics
        return (*self.numerics, self.derived.share, self.derived.gap, self.derived.pay)

    @property
    def model_columns(self) -> tuple[str, ...]:
        return (*self.model_categoricals, *self.model_numerics)

    def caption(self, column: str) -> str:
        return self.breakdowns.get(column, column)

    def label(self, column: str) -> str:
        return self.labels.get(column, column)
