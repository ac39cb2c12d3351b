"""Quality gates: named checks that must hold, and runs of stages under them (Q1, Q2, Q5-Q9, Q13)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame


@dataclass
class Gates:
    """A registry of named checks; only registered names may be checked, a failure raises, and each leaves a record."""

    names: dict[str, str]
    records: list[dict] = field(default_factory=list)

    def check(self, name: str, holds: bool, detail: str = "") -> None:
        if name not in self.names:
            raise KeyError(f"no gate is called {name}")
        self.records.append({"gate": name, "status": "PASS" if holds else "FAIL", "detail": detail})
        if not holds:
            raise AssertionError(f"{name}: {self.names[name]} {detail}".strip())

    def not_run(self, name: str, why: str) -> None:
        if name not in self.names:
            raise KeyError(f"no gate is called {name}")
        self.records.append({"gate": name, "status": "NOT_RUN", "detail": why})

    def check_unique(self, name: str, rows: DataFrame, keys: list[str]) -> None:
        again = rows.groupBy(*keys).count().where("count > 1").limit(1).count()
        self.check(name, again == 0, f"keys {keys}")

    def check_columns(self, name: str, rows: DataFrame, columns: list[str]) -> None:
        self.check(name, list(rows.columns) == columns, f"{set(rows.columns) ^ set(columns) or ''}")

    def summary(self) -> dict[str, int]:
        return {s: sum(r["status"] == s for r in self.records) for s in ("PASS", "FAIL", "NOT_RUN")}


def compare_metrics(now: dict[str, float], then: dict[str, float], expected: set[str] = frozenset(), rtol: float = 1e-6, atol: float = 1e-4) -> dict[str, str]:
    """Q5, Q7, Q8: EQUAL, EXPECTED_CHANGE, CHANGED or MISSING for each metric of a baseline."""
    out = {}
    for name, old in then.items():
        new = now.get(name)
        same = new is not None and abs(new - old) <= atol + rtol * abs(old)
        out[name] = "MISSING" if new is None else "EQUAL" if same else "EXPECTED_CHANGE" if name in expected else "CHANGED"
    return out


def by_stage(catalogue: dict[str, dict[str, str]]) -> Gates:
    """Q2: the gates of all stages, called stage.name; a name stands once."""
    return Gates({f"{stage}.{name}": text for stage, gates in catalogue.items() for name, text in gates.items()})


def manifest(paths: list[str]) -> dict[str, str]:
    """Q9: SHA-256 of files of the driver, read in blocks; a path without a file is missing."""
    out = {}
    for path in sorted(paths):
        if not Path(path).is_file():
            out[path] = "missing"
            continue
        with open(path, "rb") as f:
            out[path] = hashlib.file_digest(f, "sha256").hexdigest()
    return out


def changed(before: dict[str, str], after: dict[str, str]) -> list[str]:
    """Q9: paths whose digests differ or that one side lacks."""
    return sorted(p for p in before.keys() | after.keys() if before.get(p) != after.get(p))


def run_stages(stages: list[tuple[str, Callable[[Gates], None]]], gates: Gates, first: str | None = None, last: str | None = None) -> dict[str, str]:
    """Q13: stages from `first` to `last` in order, each clearing its old gate records; a failure stops the run.

    Returns DONE, FAILED, SKIPPED (outside the range) or NOT_RUN (behind a failure) by stage. Unknown names are an error.
    """
    names = [n for n, _ in stages]
    lo, hi = names.index(first) if first else 0, names.index(last) if last else len(names) - 1
    if lo > hi:
        raise ValueError(f"{first} is behind {last}")
    out, broken = {}, False
    for i, (name, stage) in enumerate(stages):
        if not lo <= i <= hi:
            out[name] = "SKIPPED"
            continue
        if broken:
            out[name] = "NOT_RUN"
            continue
        gates.records[:] = [r for r in gates.records if not r["gate"].startswith(f"{name}.")]
        try:
            stage(gates)
            out[name] = "DONE"
        except AssertionError:
            out[name], broken = "FAILED", True
    return out
