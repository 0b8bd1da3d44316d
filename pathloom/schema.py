"""Schemas of the tables that operators exchange, and the options of a fit."""

from __future__ import annotations

import math
from dataclasses import dataclass


#: Distances and quantised weights stay below this.
INFINITY = 2**31 - 1
MAX_ID = 2**32 - 1
MAX_TRANSITIONS = 12_000_000

NODES = "node_id long, x float, y float"
EDGES = "edge_id long, tail long, head long, baseline double"
TRIPS = "sample_id string, edges array<long>"
TRANSITIONS = "coord long, prev long, next long, w0 double, lo double, hi double"
PATHS = "qid long, distance long, nodes array<long>, coords array<long>"
RECORD = "sample_id string, original_edge_ids array<long>"
PREDICTION = "sample_id string, predicted_edge_ids array<long>"


@dataclass(frozen=True)
class FitOptions:
    """Options of the projected subgradient fit; bad ones are rejected when made."""

    eta0: float = 0.5
    lam: float = 0.1
    lower: float = 0.1
    upper: float = 10.0
    updates: int = 1

    def __post_init__(self) -> None:
        numbers = (self.eta0, self.lam, self.lower, self.upper)
        if not all(isinstance(x, (int, float)) and math.isfinite(x) for x in numbers):
            raise ValueError("options must be finite numbers")
        if self.eta0 <= 0:
            raise ValueError("eta0 must be positive")
        if self.lam < 0:
            raise ValueError("lambda must not be negative")
        if not 0 < self.lower <= 1 <= self.upper:
            raise ValueError("factors must satisfy 0 < lower <= 1 <= upper")
        if isinstance(self.updates, bool) or not isinstance(self.updates, int) or self.updates < 1:
            raise ValueError("updates must be a positive integer")
