"""SVG paths back to rings, and lines with points at equal steps."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RINGS = "array<array<struct<lon:double,lat:double>>>"
#: A command's letter or a number; numbers may stand without anything between them.
_TOKEN = re.compile(r"[A-Za-z]|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")
#: Numbers that a command takes at a time.
_TAKES = {"m": 2, "l": 2, "h": 1, "v": 1, "t": 2, "q": 4, "s": 4, "c": 6, "a": 7, "z": 0}


def rings_of_path(path: str | None) -> list[list[dict]]:
    """The sub-paths of a path as points, those of at least two; y grows downwards in a path.

    Lines are read in absolute and relative form; of a curve the end counts. A closed sub-path ends where it began. What
    follows an unknown command, or is too little for one, is passed over.
    """
    lines: list[list[tuple[float, float]]] = []
    x = y = 0.0
    command, numbers = "", []
    for token in _TOKEN.findall(path or ""):
        if token.isalpha():
            command, numbers = token, []
            if token in "Zz" and lines and lines[-1]:
                x, y = lines[-1][0]
                if lines[-1][-1] != (x, y):
                    lines[-1].append((x, y))
            continue
        numbers.append(float(token))
        kind = command.lower()
        if len(numbers) < _TAKES.get(kind, 0) or not _TAKES.get(kind):
            continue
        dx, dy = (x, y) if command.islower() else (0.0, 0.0)
        x, y = (numbers[-1] + dx, y) if kind == "h" else (x, numbers[-1] + dy) if kind == "v" else (numbers[-2] + dx, numbers[-1] + dy)
        if kind == "m":
            lines.append([])
            command = "l" if command == "m" else "L"
        elif not lines:
            lines.append([(dx, dy)])
        lines[-1].append((x, y))
        numbers = []
    return [[{"lon": px, "lat": 0.0 - py} for px, py in line] for line in lines if len(line) > 1]


def from_path(path: Column) -> Column:
    return F.pandas_udf(lambda values: values.map(rings_of_path), RINGS)(path)


def spaced(points: np.ndarray, count: int) -> np.ndarray:
    """So many points along a line, both ends among them, the same way apart along it; a line without length gives its first point."""
    if len(points) < 2 or count < 2:
        return points
    way = np.concatenate([[0.0], np.cumsum(np.hypot(*np.diff(points, axis=0).T))])
    if not way[-1]:
        return np.repeat(points[:1], count, axis=0)
    at = np.linspace(0.0, way[-1], count)
    return np.column_stack([np.interp(at, way, points[:, k]) for k in (0, 1)])


def resampled(rings: Column, count: int) -> Column:
    """Each ring as so many points in equal steps along it."""

    def one(value) -> list | None:
        lines = ([(p["lon"], p["lat"]) for p in ring] for ring in value) if value is not None else ()
        made = [spaced(np.array(line, float).reshape(-1, 2), count).tolist() for line in lines]
        return None if value is None else [[{"lon": a, "lat": b} for a, b in line] for line in made]

    def run(values: pd.Series) -> pd.Series:
        return values.map(one, na_action=None)

    return F.pandas_udf(run, RINGS)(rings)
