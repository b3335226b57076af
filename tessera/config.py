"""Phases, thresholds and their configuration file (S16). No global state: what a query needs is passed to it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date
from pathlib import Path

import yaml


@dataclass(frozen=True)
class Phase:
    """A closed interval of dates with a label."""

    phase_id: str
    label: str
    start: date
    end: date
    color: str = ""


def phases_of(entries: Sequence[dict]) -> tuple[Phase, ...]:
    """Phases sorted by their start."""
    day = lambda x: x if isinstance(x, date) else date.fromisoformat(str(x))
    found = [Phase(str(e["id"]), str(e.get("label", e["id"])), day(e["start"]), day(e["end"]), str(e.get("color", ""))) for e in entries]
    return tuple(sorted(found, key=lambda p: p.start))


def parse_phase(text: str) -> Phase:
    """A phase given as start:end:label."""
    start, end, label = text.split(":", 2)
    return Phase(label, label, date.fromisoformat(start), date.fromisoformat(end))


def load(path: str | Path) -> dict:
    """The configuration as a dict; `phases` becomes a tuple of Phase."""
    found = yaml.safe_load(Path(path).read_text()) or {}
    return found | {"phases": phases_of(found.get("phases", []))}
