"""Paths and equal steps, with results worked out by hand."""

import numpy as np
import pytest

from terrace.functions import svg


@pytest.mark.parametrize(
    ("path", "want"),
    [
        ("M 1 2 L 3 4 5 6 Z", [[(1, -2), (3, -4), (5, -6), (1, -2)]]), ("M1,2L3-4.5.5", [[(1, -2), (3, 4.5)]]), ("m 1 1 2 0 0 2 z m 5 5 1 0", [[(1, -1), (3, -1), (3, -3), (1, -1)], [(6, -6), (7, -6)]]),
        ("M0 0H2V3h-1v1z", [[(0, 0), (2, 0), (2, -3), (1, -3), (1, -4), (0, 0)]]), ("M0 0C1 1 2 2 3 0Q4 1 5 0A1 1 0 0 1 6 0", [[(0, 0), (3, 0), (5, 0), (6, 0)]]), ("M 1e1 -2E-1 L +1 .5", [[(10, 0.2), (1, -0.5)]]),
        ("M 1 1", []), ("", []), (None, []), ("no path", []), ("L 3 4", [[(0, 0), (3, -4)]]), ("M 0 0 L 1", []),
    ],
)
def test_paths(path, want):
    assert [[(p["lon"], p["lat"]) for p in line] for line in svg.rings_of_path(path)] == want


def test_equal_steps():
    line = np.array([(0.0, 0.0), (3.0, 0.0), (3.0, 0.0), (3.0, 1.0)])
    assert svg.spaced(line, 5).tolist() == [[0, 0], [1, 0], [2, 0], [3, 0], [3, 1]]
    assert svg.spaced(line[:1], 5).tolist() == [[0, 0]] and svg.spaced(line[1:3], 3).tolist() == [[3, 0]] * 3 and len(svg.spaced(line, 1)) == 4
    rng = np.random.default_rng(1)
    for _ in range(20):
        walk = np.cumsum(rng.normal(size=(30, 2)), axis=0)
        made = svg.spaced(walk, 50)
        assert np.allclose(made[[0, -1]], walk[[0, -1]])
        # Every point lies on the line, as far along it as its number says.
        way = np.concatenate([[0], np.cumsum(np.hypot(*np.diff(walk, axis=0).T))])
        for k, p in enumerate(made):
            at = way[-1] * k / 49
            i = min(np.searchsorted(way, at, side="right"), len(walk) - 1)
            assert np.allclose(p, walk[i - 1] + (walk[i] - walk[i - 1]) * (at - way[i - 1]) / (way[i] - way[i - 1]))
