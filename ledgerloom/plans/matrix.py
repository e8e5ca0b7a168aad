"""A matrix of runs: dependency order, resumption by config hash, failures kept apart. Small and driver-side by nature."""

from __future__ import annotations

import hashlib
import json
import traceback
from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Run:
    name: str
    needs: tuple[str, ...] = ()
    config: dict = field(default_factory=dict)

    @property
    def config_hash(self) -> str:
        return hashlib.sha256(json.dumps(self.config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def resolution_order(runs: list[Run]) -> list[Run]:
    """Runs after what they need; names are in order where nothing decides. Unknown and circular needs raise."""
    by = {r.name: r for r in runs}
    for r in runs:
        if missing := [n for n in r.needs if n not in by]:
            raise ValueError(f"{r.name} needs {missing[0]}, which there is not")
    out: list[Run] = []
    left = sorted(by)
    while left:
        ready = next((n for n in left if all(m not in left for m in by[n].needs)), None)
        if ready is None:
            raise ValueError(f"runs need each other: {left}")
        left.remove(ready)
        out.append(by[ready])
    return out


def run_matrix(runs: list[Run], execute: dict[str, Callable[[Run], object]], done: dict[str, str]) -> dict[str, tuple[str, str]]:
    """Status by run: COMPLETED, SKIPPED (done under the same config), FAILED (with the error), BLOCKED (with the need that isn't met), PENDING (nothing executes it)."""
    status: dict[str, tuple[str, str]] = {}
    for run in resolution_order(runs):
        blocker = next((n for n in run.needs if status[n][0] not in ("COMPLETED", "SKIPPED")), None)
        if blocker:
            status[run.name] = ("BLOCKED", blocker)
        elif done.get(run.name) == run.config_hash:
            status[run.name] = ("SKIPPED", "")
        elif run.name not in execute:
            status[run.name] = ("PENDING", "")
        else:
            try:
                execute[run.name](run)
                status[run.name] = ("COMPLETED", run.config_hash)
            except Exception:  # one run's failure is a row of the report, not the end of the matrix
                status[run.name] = ("FAILED", traceback.format_exc(limit=1).strip().splitlines()[-1])
    return status


def allocate_evenly(available: dict[str, int], total: int, cap: float = 0.35) -> dict[str, int]:
    """As even a share as what is available and the cap on one stratum's share allow.

    The level that all strata reach or run out below is found from the smallest room up; what is left over goes by name.
    """
    most = int(total * cap)
    room = sorted((min(v, most), k) for k, v in available.items())
    left, level, full = min(total, sum(v for v, _ in room)), 0, len(room)
    for v, _ in room:
        if (v - level) * full > left:
            break
        left -= (v - level) * full
        level, full = v, full - 1
    rise, over = divmod(left, full) if full else (0, 0)
    out = {k: min(v, level + rise) for v, k in room}
    for k in sorted(k for v, k in room if v > level + rise)[:over]:
        out[k] += 1
    return {k: out[k] for k in available}


def retry_delay(attempt: int, base: float, cap: float, jitter: float, retry_after: float | None = None) -> float:
    """Exponential back-off with full jitter (`jitter` in [0, 1)); a server's own delay comes first."""
    return retry_after if retry_after is not None else min(cap, base * 2**attempt) * jitter
