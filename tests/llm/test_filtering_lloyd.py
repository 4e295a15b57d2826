"""op11 against plain Lloyd rounds over all entries, and the trees' filtering against all distances."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from loomtext.llm import filtering_lloyd as fl
from loomtext.llm import queries
from tests.llm.cases import saved

SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, part int"


def plain(rows, parts=16, entries=64, rounds=2):
    """Rows (id, vector, label) -> sorted (id, code, error, label_error, digest), with Python's integers."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(kept[0][1])
    width = size // parts
    other = [r for r in kept if len(r[1]) != size]
    kept = [r for r in kept if len(r[1]) == size]
    cut = lambda v: [tuple(v[p * width : (p + 1) * width]) for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda x, book: min(range(len(book)), key=lambda e: (far(x, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            mine = defaultdict(list)
            for _, v, _ in kept:
                x = cut(v)[p]
                mine[nearest(x, books[p])].append(x)
            for e, xs in mine.items():
                books[p][e] = tuple(sum(c) // len(xs) for c in zip(*xs))
    digest = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    out, labels = [], defaultdict(int)
    for i, v, label in kept:
        codes = [nearest(x, books[p]) for p, x in enumerate(cut(v))]
        error = sum(far(x, books[p][c]) for p, (x, c) in enumerate(zip(cut(v), codes)))
        labels[label] += error
        out.append((i, "".join(f"{c:02x}" for c in codes), error, label))
    out += [(i, None, None, label) for i, _, label in other]
    return sorted(map(repr, [(i, code, error, labels.get(label), digest) for i, code, error, label in out]))


def run(spark, path, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    return sorted(repr(tuple(r)) for r in queries.op11_filtering_lloyd(spark, saved(spark, path, df, "embeddings")).collect())


def vectors(n, seed, size=64, scale=0.1):
    return np.random.default_rng(seed).normal(size=(n, size)).astype(np.float32) * np.float32(scale)


def test_query_against_plain_rounds(spark, tmp_path):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert sorted(repr(tuple(r)) for r in queries.op11_filtering_lloyd(spark, "/root/testdata/sf0.001").collect()) == plain(rows)


def test_odd_rows(spark, tmp_path):
    v = vectors(150, 5).tolist()
    rows = [(i, x, None if i % 5 == 0 else i % 3) for i, x in enumerate(v)]
    rows += [(3, v[3], 1), (3, v[9], 1), (None, v[7], None), (None, v[8], 2), (200, None, 1), (201, [None] + v[0][1:], 1), (202, [float("nan")] + v[0][1:], 1), (203, [float("-inf")] + v[0][1:], 1)]
    rows += [(300 + i, v[11], 2) for i in range(90)] + [(400, v[0][:32], 2), (401, [], None), (-5, [0.0] * 64, None)]
    assert run(spark, tmp_path / "a", rows) == plain(rows)
    few = [(i, x, 0) for i, x in enumerate(v[:3])]  # fewer vectors than entries
    assert run(spark, tmp_path / "b", few) == plain(few)
    assert run(spark, tmp_path / "c", []) == [] and run(spark, tmp_path / "d", [(1, None, 2), (2, [None] * 64, 2)]) == []


def test_several_blocks(spark, tmp_path, monkeypatch):
    """Results do not depend on the blocks: 9,000 vectors in one partition are two of them."""
    v = vectors(9000, 2, 8, 0.5)
    df = spark.createDataFrame([(i, x, i % 7) for i, x in enumerate(v.tolist())], "vec_id bigint, embedding array<float>, label int")
    one = fl.compress(df.coalesce(1), parts=2, entries=16, rounds=2).collect()
    many = fl.compress(df.repartition(7), parts=2, entries=16, rounds=2).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many)) and len(one) == 9000
    model = fl.train(df, parts=2, entries=16, rounds=2)
    x = np.floor(v.astype(np.float64) * 256).astype(np.int64).reshape(9000, 2, 4)
    d = ((x[:, :, None] - model.entries[None]) ** 2).sum(3)
    got = {r["vec_id"]: r for r in one}
    assert all(got[i]["code"] == "".join(f"{c:02x}" for c in d[i].argmin(1)) and got[i]["error"] == d[i].min(1).sum() for i in range(9000))


def test_labels_beyond_the_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fl, "SMALL", 1)
    rows = [(i, x, i % 4 or None) for i, x in enumerate(vectors(120, 8).tolist())]
    assert run(spark, tmp_path, rows) == plain(rows)


@pytest.mark.parametrize("n,k,width,scale", [(1, 1, 4, 9), (7, 5, 2, 2), (64, 64, 4, 3), (3000, 64, 4, 40), (3000, 300, 3, 4000), (2000, 64, 1, 6), (500, 8, 4, 0)])
def test_filtering_is_exact(n, k, width, scale):
    """Codes, sums and counts are those of all distances, with many ties; tight groups go as whole subtrees."""
    rng = np.random.default_rng(n + k)
    points = np.floor(rng.normal(size=(3, n, width)) * scale).astype(np.int64)
    books = points[:, rng.integers(0, n, k)].copy()
    tree = fl.build(points)
    ordered = np.take_along_axis(points, tree[0][:, :, None], 1)
    codes, counts, sums, whole = fl.assign(tree, ordered, books)
    for p in range(3):
        want = ((ordered[p][:, None] - books[p][None]) ** 2).sum(2).argmin(1)
        assert (codes[p] == want).all() and (counts[p] == np.bincount(want, minlength=k)).all()
        assert all((sums[p, e] == ordered[p][want == e].sum(0)).all() for e in range(k))
    if scale == 0:
        assert whole == 3 * n
    far = np.repeat(np.array([[0] * width, [1000] * width]), n, 0)[None] + rng.integers(0, 3, (1, 2 * n, width))
    tree = fl.build(far)
    ends = np.array([[[1] * width, [1001] * width]])
    assert fl.assign(tree, np.take_along_axis(far, tree[0][:, :, None], 1), ends)[3] >= 2 * n - 2 * fl.LEAF


def test_errors(spark):
    schema = "vec_id bigint, embedding array<float>, label int"
    with pytest.raises(ValueError, match="can't be cut"):
        fl.compress(spark.createDataFrame([(1, [0.5] * 20, 1)], schema))
    with pytest.raises(ValueError, match="is over"):
        fl.compress(spark.createDataFrame([(1, [3e30] * 16, 1)], schema))
