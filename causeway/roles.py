"""The question that is asked of a table: which column plays which part."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

ABSENT = {"none", "**none**", "", "null"}


def role(value: Any) -> str | None:
    """A column name; the texts that stand for no column give None."""
    if value is None or (isinstance(value, str) and value.strip().lower() in ABSENT):
        return None
    return value.strip() if isinstance(value, str) else value


def role_list(value: Any) -> list[str]:
    """Column names from a list or a text separated by commas; texts that stand for none give an empty list."""
    items = value.split(",") if isinstance(value, str) else (value or [])
    return [r for r in (role(x) for x in items) if r]


def number(value: Any) -> float | None:
    value = role(value)
    try:
        return None if value is None else float(value)
    except (TypeError, ValueError):
        return None


@dataclass(frozen=True)
class CausalQuery:
    treatment: str
    outcome: str
    time: str | None = None
    group: str | None = None
    running: str | None = None
    cutoff: float | None = None
    instruments: tuple[str, ...] = ()
    mediators: tuple[str, ...] = ()
    adjustment: tuple[str, ...] = ()
    algorithm: str | None = None
    randomized: bool = False
    latent: bool = False

    @classmethod
    def of(cls, treatment: str, outcome: str, **parts: Any) -> CausalQuery:
        """Accepts texts for every part, as a parsed answer has them. Instruments force the algorithm IV."""
        given = {k: role(parts.get(k)) for k in ("time", "group", "running", "algorithm")}
        lists = {k: tuple(role_list(parts.get(k))) for k in ("instruments", "mediators", "adjustment")}
        if lists["instruments"]:
            given["algorithm"] = "IV"
        flags = {k: bool(parts.get(k, False)) for k in ("randomized", "latent")}
        if not role(treatment) or not role(outcome):
            raise ValueError("a treatment and an outcome are needed")
        return cls(role(treatment), role(outcome), cutoff=number(parts.get("cutoff")), **given, **lists, **flags)

    def check(self, columns: list[str]) -> None:
        named = [self.treatment, self.outcome, self.time, self.group, self.running, *self.instruments, *self.mediators, *self.adjustment]
        if missing := sorted({c for c in named if c} - set(columns)):
            raise ValueError(f"no such columns: {', '.join(missing)}")


@dataclass(frozen=True)
class EffectPlan:
    method: str
    adjustment: tuple[str, ...] = ()
    instruments: tuple[str, ...] = ()
    mediators: tuple[str, ...] = ()
    reason: str = ""
    extra: dict = field(default_factory=dict)
