"""Small records of a live run beside its data: catalogs, summaries, health, archives, a lock, a vault."""

from __future__ import annotations

import datetime as dt
import json
import os
import shutil
import time
from collections.abc import Callable, Iterable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame

from barlattice.sources.klines import save_state


def write_catalog(rows: DataFrame, path: str, key: str, most: int = 10_000) -> None:
    """A small table as one readable JSON object by ``key``; more than ``most`` rows raise."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a catalog has at most {most} rows")
    save_state(path, {str(r[key]): {k: v for k, v in r.asDict(True).items() if k != key} for r in found})


def write_summary(path: str, **parts: DataFrame | dict | str | float | None) -> None:
    """A nested report: tables of results (each at most 1000 rows) and plain values by name."""

    def plain(value: Any) -> Any:
        if not isinstance(value, DataFrame):
            return value
        found = value.limit(1001).collect()
        if len(found) > 1000:
            raise ValueError("a summary holds results, not data")
        return [r.asDict(True) for r in found]

    save_state(path, {"written_at": dt.datetime.now(dt.timezone.utc).isoformat(), **{k: plain(v) for k, v in parts.items()}})


def archive_record(folder: str, names: Iterable[str], archive: str, reason: str, dry_run: bool = False) -> str:
    """Moves the named files of a live record to a dated folder with a manifest; returns that folder.

    Files that are not there are listed as absent; with ``dry_run`` nothing moves.
    """
    source, names = Path(folder), list(names)
    target = Path(archive) / dt.datetime.now(dt.timezone.utc).strftime("record_%Y%m%dT%H%M%S%f")
    there = [n for n in names if (source / n).exists()]
    if not dry_run:
        target.mkdir(parents=True)
        for n in there:
            shutil.move(source / n, target / n)
        save_state(str(target / "manifest.json"), {"reason": reason, "archived": there, "absent": [n for n in names if n not in there]})
    return str(target)


def leftovers(folder: str, names: Iterable[str]) -> list[str]:
    """The named files that are still in the folder."""
    return [n for n in names if (Path(folder) / n).exists()]


class SingleWriter:
    """A lock file with the writer's process: ``with SingleWriter(path): ...``; a lock whose process is gone is taken over."""

    def __init__(self, path: str):
        self.path = Path(path)

    def _alive(self) -> bool:
        try:
            os.kill(int(self.path.read_text()), 0)
            return True
        except PermissionError:
            return True
        except (OSError, ValueError):
            return False

    def __enter__(self) -> SingleWriter:
        for _ in range(2):
            try:
                handle = os.open(self.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
            except FileExistsError:
                if self._alive():
                    raise RuntimeError(f"{self.path} is held by another writer") from None
                self.path.unlink(missing_ok=True)
                continue
            with os.fdopen(handle, "w") as f:
                f.write(str(os.getpid()))
            return self
        raise RuntimeError(f"{self.path} is held by another writer")

    def __exit__(self, *_: object) -> None:
        self.path.unlink(missing_ok=True)


class Vault:
    """Held-out bars that can be evaluated a fixed number of times; each use is spent before it runs and is logged."""

    def __init__(self, data: DataFrame, budget: int):
        self._data, self.remaining, self._log = data, budget, []

    @property
    def log(self) -> list[dict]:
        return [dict(entry) for entry in self._log]

    def evaluate(self, evaluate: Callable[[DataFrame], Any], experiment: str, caller: str = "") -> Any:
        if self.remaining <= 0:
            raise PermissionError("the vault's budget is spent")
        self.remaining -= 1
        entry = {"at_us": int(time.time() * 1e6), "experiment": experiment, "caller": caller, "remaining": self.remaining, "result": None}
        self._log.append(entry)
        entry["result"] = evaluate(self._data)
        return entry["result"]


def read_record(path: str) -> dict:
    return json.loads(Path(path).read_text())
