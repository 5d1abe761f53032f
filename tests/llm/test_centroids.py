import hashlib
import math
import random

import numpy as np
import pytest

from lagweave.llm import centroids

KIND = "vec_id bigint, embedding array<double>, label int, planes int, cluster int"


def brute(rows, clusters=16, rounds=3, dims=64):
    """Plain integers and loops."""
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest()))
    c = [list(v) for _, v in order[:clusters]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((far(v, m), k) for k, m in enumerate(c))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for k in range(len(c)):
            mine = [v for (_, v), a in zip(kept, at) if a == k]
            if mine:
                c[k] = [sum(x) // len(mine) for x in zip(*mine)]
    got = [(i, near(v)[1], near(v)[0]) for i, v in kept]
    by = lambda k: sum(d for _, a, d in got if a == k)
    return sorted((str(i), k, d, by(k), sum(x[2] for x in got), hashlib.sha256(",".join(map(str, c[k])).encode()).hexdigest()) for i, k, d in got)


def shown(df, **more):
    return sorted((str(r.vec_id), *r[1:]) for r in centroids.with_inertia(*centroids.cluster(df, **more)).collect())


def test_planes():
    r = np.random.default_rng(0)
    v, c = r.integers(-300, 300, (50, 70)), r.integers(-9, 9, (4, 70))
    x, p = centroids.pack(v), centroids.pack(c)
    assert (centroids.unpack(x, 70) == v).all() and (centroids.dots(x, p) == v @ c.T).all() and (centroids.squares(x) == (v * v).sum(1)).all()
    at, far = centroids.nearest(x, p)
    want = ((v[:, None] - c[None]) ** 2).sum(2)
    assert (at == want.argmin(1)).all() and (far == want.min(1)).all()


def test_against_loops(spark):
    r = random.Random(5)
    vector = lambda: [r.uniform(-0.7, 0.7) for _ in range(64)]
    same = vector()
    rows = [(i, vector() if i % 3 else same) for i in range(150)]
    rows += [(900, None), (901, [0.5] * 63), (902, [0.5] * 65), (903, []), (904, [None, *[0.1] * 63]), (905, [math.nan, *[0.1] * 63]), (906, [-math.inf, *[0.1] * 63])]
    rows += [(None, vector()), (907, [1000.25, *[-0.1] * 63]), (7, rows[7][1]), (7, rows[7][1])]
    got = shown(spark.createDataFrame([(*x, 1, 2, 3) for x in rows], KIND))
    assert got == brute(rows) and len(got) == 154


def test_few_and_none(spark):
    few = [(1, [0.25] * 64), (2, [0.25] * 64), (3, [-0.5] * 64)]
    assert shown(spark.createDataFrame([(*x, 0, 0, 0) for x in few], KIND)) == brute(few)
    assert shown(spark.createDataFrame([], KIND)) == []
    other = [(i, [i / 10, -i / 7, 0.3]) for i in range(20)]
    assert shown(spark.createDataFrame([(*x, 0, 0, 0) for x in other], KIND), dims=3, clusters=4) == brute(other, 4, dims=3)


def test_too_large_raises(spark):
    with pytest.raises(Exception, match="do not fit|would not fit"):
        shown(spark.createDataFrame([(1, [1e30] * 64, 0, 0, 0)], KIND))
