"""Depths are measured where they are made, and what rows have in common is worked out once, with the same numbers."""

import io

import numpy as np
import pandas as pd
import pytest

from boxloom.functions import kernels as K
from boxloom.plans import load_registry

SF = "/root/testdata/sf0.001"


def test_scenes_stay_in_their_worker(spark):
    plan = load_registry()["depth_measurements"].build(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1


def saved(array, version=None):
    out = io.BytesIO()
    np.lib.format.write_array(out, array, version)
    return out.getvalue()


def scene(seed, shape=(120, 120)):
    y, x = np.mgrid[: shape[0], : shape[1]]
    return 900 + 0.3 * x - 0.2 * y + np.random.default_rng(seed).normal(0, 1, shape)


def test_draws_and_roads_are_made_once(monkeypatch):
    made = {"rng": 0, "dilate": 0}

    def counted(name, f):
        def run(*args):
            made[name] += 1
            return f(*args)

        return run

    square = [{"x": 0.3, "y": 0.3}, {"x": 0.6, "y": 0.3}, {"x": 0.6, "y": 0.6}, {"x": 0.3, "y": 0.6}]
    batch = {"stem": ["a", "b", "c"], "depth": [saved(scene(i, (121, 119))) for i in range(3)], "points": [square] * 3}
    monkeypatch.setattr(K.np.random, "default_rng", counted("rng", np.random.default_rng))
    monkeypatch.setattr(K, "dilate", counted("dilate", K.dilate))
    rows = [r for b in K.measured(iter([pd.DataFrame(batch)])) for r in b.itertuples()]
    assert len(rows) == 3 and made == {"rng": 1, "dilate": 2}


def all_tries(x, y, z, seed=0, tries=100):
    """The fit without shortcuts."""
    rng = np.random.default_rng(seed)
    if len(z) > K.MOST_FIT:
        take = rng.choice(len(z), K.MOST_FIT, replace=False)
        x, y, z = x[take], y[take], z[take]
    a = np.column_stack([x, y, np.ones(len(x))]).astype(float)
    limit = max(float(np.median(np.abs(z - np.median(z)))), 1e-9)
    threes = [rng.choice(len(z), 3, replace=False) for _ in range(tries)]
    close = [np.abs(np.linalg.solve(a[t], z[t]) @ a.T - z) <= limit for t in threes]
    best = close[int(np.argmax([k.sum() for k in close]))]
    return np.linalg.lstsq(a[best], z[best], rcond=None)[0], float(best.mean())


@pytest.mark.parametrize(("n", "outliers"), [(60, 0), (3000, 0), (3000, 1400), (9000, 0), (9000, 4000)])
def test_fit_equals_one_of_all_tries(n, outliers):
    rng = np.random.default_rng(n + outliers)
    x, y = rng.integers(0, 200, (2, n))
    z = 900 + 0.3 * x - 0.2 * y + rng.normal(0, 1, n)
    z[:outliers] += rng.normal(0, 90, outliers)
    for _ in range(2):
        plane, share = K.fit_plane(x, y, z)
        want, want_share = all_tries(x, y, z)
        assert share == want_share and np.allclose(plane, want, rtol=1e-9, atol=0)


@pytest.mark.parametrize("array", [scene(1), np.asfortranarray(scene(2)[:7]), np.arange(6, dtype=">u2").reshape(2, 3), np.zeros((0, 4)), np.array(5.0), np.array([True, False])])
@pytest.mark.parametrize("version", [(1, 0), (2, 0)])
def test_arrays_are_read_as_saved(array, version):
    got = K.load_array(saved(array, version))
    assert got.dtype == array.dtype and got.shape == array.shape and (got == array).all()


def test_broken_arrays_are_refused():
    objects = io.BytesIO()
    np.save(objects, np.array([{}], object), allow_pickle=True)
    for data in (saved(scene(3))[:-1], objects.getvalue(), b"\x93NUMPY\x01\x00"):
        with pytest.raises(ValueError):
            K.load_array(data)
