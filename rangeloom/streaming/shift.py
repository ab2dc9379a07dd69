"""Workload shift: compare what is asked now with what a layout was built for."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np

from rangeloom.functions.workload import query_histogram, skew, spans_of
from rangeloom.plans.layout import Layout, LayoutOptions, build_layout
from rangeloom.plans.model import RangeQuery


def signature(query: RangeQuery) -> tuple[str, ...]:
    """A query's type: the columns that it constrains."""
    return tuple(sorted(query.where.ranges))


def kl(p: dict, q: dict, smooth: float = 1e-3) -> float:
    """Divergence of histogram p from q over the types of both, smoothed."""
    keys = sorted({*p, *q})
    a, b = (np.array([h.get(k, 0) for k in keys], float) + smooth for h in (p, q))
    a, b = a / a.sum(), b / b.sum()
    return float((a * np.log(a / b)).sum())


def _count(queries: Sequence[RangeQuery]) -> dict:
    out: dict = {}
    for q in queries:
        out[signature(q)] = out.get(signature(q), 0) + 1
    return out


@dataclass(frozen=True)
class ShiftEvent:
    kind: str
    value: float
    threshold: float


@dataclass
class ShiftMonitor:
    """Windows of observed queries, checked against the reference workload; each kind of event has a cooldown."""

    reference: list[RangeQuery]
    boxes: dict[str, tuple[float, float]]
    divergence: float = 0.20
    drift: float = 2.0
    skew_gain: float = 2.0
    cooldown: float = 60.0
    window: int = 200
    least: int = 100
    seen: deque = field(default_factory=deque)
    raised: dict[str, float] = field(default_factory=dict)

    def observe(self, query: RangeQuery, now: float | None = None) -> list[ShiftEvent]:
        self.seen.append(query)
        while len(self.seen) > self.window:
            self.seen.popleft()
        return self.check(now) if len(self.seen) >= self.least else []

    def check(self, now: float | None = None) -> list[ShiftEvent]:
        now = time.time() if now is None else now
        before, after = _count(self.reference), _count(list(self.seen))
        found = [ShiftEvent("types", kl(after, before), self.divergence)]
        share = lambda h, k: (h.get(k, 0) + 0.5) / (sum(h.values()) + 1)
        found.append(ShiftEvent("frequency", max((max(r := share(after, k) / share(before, k), 1 / r) for k in {*before, *after}), default=1.0), self.drift))
        for c, (lo, hi) in self.boxes.items():
            old, new = (skew(query_histogram(spans_of(q, c, lo, hi), lo, hi, 64)) for q in (self.reference, list(self.seen)))
            found.append(ShiftEvent(f"skew of {c}", (new + 1) / (old + 1), self.skew_gain))
        out = [e for e in found if e.value > e.threshold and now - self.raised.get(e.kind, -1e18) >= self.cooldown]
        self.raised |= {e.kind: now for e in out}
        return out

    def rebuild_if_shifted(self, layout: Layout, path: str, options: LayoutOptions = LayoutOptions(), now: float | None = None) -> Layout:
        """A new layout for the observed window if an event is due; else the same one."""
        if len(self.seen) < self.least or not self.check(now):
            return layout
        self.reference = list(self.seen)
        return build_layout(layout.main.select(*layout.columns), layout.columns, self.reference, path, options)
