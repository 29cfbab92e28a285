"""Options of a run: immutable, and handed over explicitly."""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field, replace

#: Linked-data modes; "all" stands for the plain ones.
PLAIN_MODES = frozenset({"celex", "oj", "eli", "ecli", "proc", "consil", "finlex-eli"})
ADVANCED_MODES = frozenset({"handoc", "cis"})
ALL = "*"


@dataclass(frozen=True)
class Optimizer:
    """A part of patterns that is replaced by a cheaper one for texts in which the probe (a pattern) doesn't occur."""

    probe: str
    search: str
    replacement: str


@dataclass(frozen=True)
class Options:
    language: str = "ENG"
    languages: str = ""
    types: frozenset[str] | None = None  # None: all; an empty set: none, and targets aren't filtered
    environments: frozenset[str] = frozenset({ALL})
    targets: frozenset[str] | None = None
    excluded_targets: tuple[str, ...] = ()
    special_rules: bool = True
    strict: frozenset[str] = frozenset()
    aliases: bool = True
    linked_data: frozenset[str] = frozenset()
    point_in_time: datetime.date | None = None
    as_of: datetime.date = datetime.date(2024, 1, 1)
    sort: str = "position.asc"
    reference_limit: int = 255
    title_limit: int = 255
    scan: str = "raw"  # or "text": only what stands between tags
    optimizers: tuple[tuple[Optimizer, ...], ...] = ()  # of each group, the first whose probe misses is applied to a text

    def with_modes(self, *modes: str) -> Options:
        """Linked-data modes; "all" leaves the advanced ones out."""
        chosen = frozenset().union(*[PLAIN_MODES if m == "all" else {m} for m in modes])
        if unknown := chosen - PLAIN_MODES - ADVANCED_MODES:
            raise ValueError(f"unknown linked-data modes: {sorted(unknown)}")
        return replace(self, linked_data=chosen)

    def with_filter(self, environments: list[str] | str | None, targets: list[str] | None, available: set[str]) -> Options:
        """Environments normalised to a set, targets narrowed to the available ones; the table target always stays, and
        nothing left is a target that matches none."""
        envs = frozenset([environments] if isinstance(environments, str) else environments or [ALL])
        if targets is None:
            return replace(self, environments=envs, targets=None)
        kept = frozenset(t for t in targets if t in available)
        return replace(self, environments=envs, targets=kept | {"table"} if kept else frozenset({"(none)"}))


@dataclass(frozen=True)
class Alias:
    """A text (or /pattern/) and what stands for it."""

    alias: str
    replacement: str
    priority: int = 0

    @property
    def is_regex(self) -> bool:
        return len(self.alias) > 2 and self.alias.startswith("/") and self.alias.endswith("/")


@dataclass(frozen=True)
class Aliases:
    """A set of aliases; every edit gives a new one. Local aliases give way to global ones of the same text."""

    shared: tuple[Alias, ...] = ()
    local: tuple[Alias, ...] = ()
    enabled: bool = True
    _none: tuple = field(default=(), repr=False)

    def added(self, alias: str, replacement: str, local: bool = False) -> Aliases:
        name = "local" if local else "shared"
        kept = tuple(a for a in getattr(self, name) if a.alias != alias)
        return replace(self, **{name: (*kept, Alias(alias, replacement))})

    def removed(self, alias: str) -> Aliases:
        return replace(self, shared=tuple(a for a in self.shared if a.alias != alias), local=tuple(a for a in self.local if a.alias != alias))

    def get(self, alias: str) -> str | None:
        return next((a.replacement for a in self.active if a.alias == alias), None)

    @property
    def active(self) -> tuple[Alias, ...]:
        if not self.enabled:
            return ()
        names = {a.alias for a in self.shared}
        return (*self.shared, *(a for a in self.local if a.alias not in names))
