"""Vector codes against plain loops over Python's integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from quorial.llm import vector_codes as V

KIND = "vec_id long, embedding array<float>, label int"


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Product codes of (id, vector, label), every distance computed."""
    good = [(i, [math.floor(scale * x) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in good), default=0) // parts)
    good = [(i, v + [0] * (width * parts - len(v)), y) for i, v, y in good]
    first = {}
    for i, v, _ in sorted((r for r in good if r[0] is not None), key=lambda r: r[:2]):
        first.setdefault(i, v)
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for v in list(first.values())[:entries]] for p in range(parts)]
    d2 = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x, book: min((d2(x, c), j) for j, c in enumerate(book))
    for _ in range(rounds if first else 0):
        for p in range(parts):
            mine = {}
            for _, v, _ in good:
                mine.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(mine[j]) for c in zip(*mine[j], strict=True)] if j in mine else b for j, b in enumerate(books[p])]
    out, by = [], {}
    for i, v, y in good:
        found = [near(cut(v, p), books[p]) for p in range(parts)] if first else []
        out.append((i, y, "".join(f"{j:02x}" for _, j in found) if first else None, sum(d for d, _ in found) if first else None))
        if first:
            by[y] = by.get(y, 0) + out[-1][3]
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((i, c, e, by.get(y), sha) for i, y, c, e in out), key=repr)


def coded(df, **more):
    return sorted((tuple(r) for r in V.vector_codes(df, **more).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


def vectors(rng, n, dim, wide=1.0):
    centres = [[rng.gauss(0, wide) for _ in range(dim)] for _ in range(5)]
    return [[float(np.float32(x + rng.gauss(0, wide / 4))) for x in rng.choice(centres)] for _ in range(n)]


@pytest.mark.parametrize(("dim", "wide"), [(64, 0.2), (24, 1e5), (8, 1.0)])
def test_codes(spark, dim, wide):
    rng = random.Random(dim)
    rows = [(i, v, rng.choice([0, 1, None])) for i, v in enumerate(vectors(rng, 120, dim, wide))]
    rows[30] = (30, rows[3][1], 1)
    assert coded(spark.createDataFrame(rows, KIND)) == plain(rows)


def test_bad_and_odd_vectors(spark):
    rng = random.Random(5)
    rows = [(i, v, i % 3) for i, v in enumerate(vectors(rng, 40, 16))]
    rows += [(100, None, 1), (101, [None] + [0.0] * 15, 1), (102, [float("nan")] * 16, 0), (103, [float("inf")] * 16, 2), (-5, [-0.00001] * 16, None), (-5, [0.5] * 16, 7), (None, [0.25] * 16, 7)]
    rows += [(104, [], 1), (105, [0.5] * 3, 1), rows[7], rows[7]]
    df = spark.createDataFrame(rows, KIND)
    assert coded(df) == plain(rows)
    wide = df.selectExpr("vec_id", "embedding", "label", "'x' AS code", "1 AS Error", "2 AS vec", "'y' AS slot")
    assert coded(wide) == plain(rows)
    assert coded(df.limit(0)) == []
    alone = [(None, [0.5] * 8, 1)]
    assert coded(spark.createDataFrame(alone, KIND)) == plain(alone)
    few = rows[:3]
    assert coded(spark.createDataFrame(few, KIND)) == plain(few)
    assert coded(df, parts=4, entries=3, rounds=2) == plain(rows, 4, 3, 2)


def test_many_labels_are_joined(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, v, rng.choice([None, *range(5)])) for i, v in enumerate(vectors(rng, 60, 8))]
    monkeypatch.setattr(V, "LABELS", 2)
    assert coded(spark.createDataFrame(rows, KIND)) == plain(rows)


def test_bounds_keep_the_nearest():
    rng = np.random.default_rng(3)
    asked = 0
    for trial in range(60):
        w, wide = int(rng.integers(1, 20)), int(rng.choice([3, 1000, 2**26 - 1]))
        x, book = (rng.integers(-wide, wide, (n, w)) for n in (50, 16))
        book[5] = book[2]
        if trial % 3 == 0:
            centre = rng.integers(-wide // 2, wide // 2, (16, w))
            book, x = centre, centre[rng.integers(0, 16, 50)] + rng.integers(-2, 3, (50, w))
        d = ((x[:, None].astype(object) - book[None].astype(object)) ** 2).sum(2)
        code, best, n = V.nearest(x, book)
        assert code.tolist() == [min(range(16), key=lambda j: (row[j], j)) for row in d] and best.tolist() == [min(r) for r in d]
        big = V.nearest(x.astype(object) * 2**30, book.astype(object) * 2**30)
        assert big[0].tolist() == code.tolist()
        asked += n if trial % 3 == 0 else 0
    assert asked < 20 * 50 * 16 / 4  # most entries are ruled out where vectors are near entries


def test_components_beyond_longs(spark):
    rows = [(i, [x] * 8, 0) for i, x in enumerate([1e30, -1e30, 1e30, 3e38, 5.0])]
    got = coded(spark.createDataFrame(rows, KIND))
    assert [r[2] for r in got] == [0] * 5
    one = V.whole(np.array([1e30, -1e30, 0.5]), 4096).tolist()
    assert one == [2**62, -(2**62), 2048]
