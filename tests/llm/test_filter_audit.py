"""op12 against its SQL and against a plain loop over documents, orders and steps."""

import itertools
import math
import re
from collections import Counter

import duckdb

from loomtext.llm import filter_audit, queries
from tests.llm.cases import TEXTS, documents, saved
from pyspark.sql import functions as F

LABELS = [(1, 1, 0), (1, 0, 1), (2, None, 1), (6, 1, None), (None, 1, 1), (9, 0, 0), (4, 1, 1)]
ODD = [
    (1, "A same text", "x"), (2, "A same text", "y"), (2, "A same text", "x"), (None, "A same text", "x"), (5, None, None), (4, "", None), (7, "", ""),
    (8, "ABC abc $", "x"), (9, "word " * 70, "x"), (10, " ".join(f"w{i}" for i in range(60)), "x"), (11, " ".join(f"w{i}" for i in range(60)), "x"), (12, "ÄÖÜ É", "y"), (1, "A same text", "x"),
]


def plain(docs, labels):
    """(part, order, step) -> the ten counts, by brute force."""
    least = {}
    for k, t, _ in docs:
        if k is not None:
            least[t or ""] = min(least.get(t or "", k), k)
    told = lambda k, i: k is not None and any(x[0] == k and x[i] == 1 for x in labels)
    rows = []
    for k, t, part in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in t) > 5 * len(t),
            "D": bool(set(t) & set("#$%&*|")), "E": k is not None and k > least[t],
        }
        rows.append((part or "", fails, told(k, 1), told(k, 2)))
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in itertools.permutations("ABCDE"):
            for i, f in enumerate(order):
                came = [r for r in mine if not any(r[1][g] for g in order[:i])]
                hit = [r for r in came if r[1][f]]
                all_hit = [r for r in mine if r[1][f]]
                only = [r for r in all_hit if sum(r[1].values()) == 1]
                shapley[part, f] += len(hit)
                out[part, "".join(order), i + 1] = [len(came) - len(hit), len(hit), len(all_hit) - len(hit), len(only), sum(r[2] for r in hit), sum(r[3] for r in hit)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_oracle(spark):
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    want = db.sql(queries.ORACLES["op12_filter_audit"])
    got = queries.op12_filter_audit(spark, "/root/testdata/sf0.001")
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_odd_rows_against_brute_force(spark, tmp_path):
    labels = spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int")
    cases = {"a": [(k, t, f"src{(k or 0) % 2}") for k, t in TEXTS], "b": ODD}
    for name, docs in cases.items():
        frame = documents(spark) if name == "a" else spark.createDataFrame([(*d, 3, "n") for d in docs], "doc_id bigint, text string, source string, mask int, n string")
        at = saved(spark, tmp_path / name, frame)
        saved(spark, at, labels, "labels")
        got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in queries.op12_filter_audit(spark, at).collect()}
        assert got == plain(docs, LABELS)


def test_empty_table(spark, tmp_path):
    at = saved(spark, tmp_path, documents(spark, []))
    saved(spark, at, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"), "labels")
    assert queries.op12_filter_audit(spark, at).collect() == []


def test_own_filters_and_orders(spark):
    """Seven filters without repeats or labels; survivors of every subset, and Shapley values that sum to all that goes."""
    rows = [(i, f"t{i}", "p", i * i % 127) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, m int")
    filters = {f"f{i}": F.when(F.col("m") == 5, None).otherwise(F.col("m").bitwiseAND(F.lit(1 << i)) != 0) for i in range(7)}
    found = filter_audit.masks(df, filters)
    z = filter_audit.survivors(found, 7).first()["z"]
    of = [0 if m == 5 else m for *_, m in rows]
    assert z == [sum(m & ~t == 0 for m in of) for t in range(128)]
    got = filter_audit.interactions(found, list(filters), orders=[[f"f{i}" for i in (3, 1, 6, 0, 2, 5, 4)]]).collect()
    assert [r["filter"] for r in sorted(got, key=lambda r: r["step"])] == ["f3", "f1", "f6", "f0", "f2", "f5", "f4"]
    assert sum(r["shapley"] for r in got) == math.factorial(7) * sum(m > 0 for m in of)
    assert sum(r["removed"] for r in got) == sum(m > 0 for m in of)
