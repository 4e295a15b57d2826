"""Reading order, redirects and concurrent calls."""

import random
import threading
import time
from pathlib import Path

import numpy as np
import pytest

from loomtext.operators import layout, redirects
from loomtext.plans import pipelines
from loomtext.plans.config import load
from loomtext.sources import connectors
from loomtext.sources.threads import expand_links

SPANS = "doc_id int, page int, x0 double, y0 double, x1 double, y1 double, text string, note string"


def order(boxes):
    place = layout.cut_order(np.array(boxes, float).reshape(-1, 4))
    return sorted(range(len(boxes)), key=lambda i: place[i])


def test_cuts():
    assert order([]) == [] and order([(0, 0, 1, 1)]) == [0]
    # Two columns of unlike lines below a head, and a foot across both.
    boxes = [(0, 0, 100, 10), (0, 20, 40, 30), (60, 20, 100, 24), (0, 32, 40, 42), (60, 27, 100, 44), (0, 60, 100, 70)]
    assert order(boxes) == [0, 1, 3, 2, 4, 5]
    # A table's cells: rows first where gaps are equal; overlapping boxes from the top down.
    assert order([(10, 10, 12, 12), (0, 0, 2, 2), (10, 0, 12, 2), (0, 10, 2, 12)]) == [1, 2, 3, 0]
    assert order([(0, 5, 9, 9), (1, 4, 8, 8), (1, 4, 8, 8)]) == [1, 2, 0]
    # Nested: the right column is cut into two once more.
    assert order([(0, 0, 40, 100), (60, 0, 75, 40), (80, 0, 95, 40), (60, 50, 95, 90)]) == [0, 1, 2, 3]


def test_long_page_of_columns():
    rng = random.Random(1)
    boxes = [(c * 50, r * 10, c * 50 + 40, r * 10 + 8) for c in range(4) for r in range(2000)]
    mixed = list(range(len(boxes)))
    rng.shuffle(mixed)
    assert [mixed[i] for i in order([boxes[i] for i in mixed])] == list(range(len(boxes)))


def test_settings_of_pages(spark):
    rows = [(1, 0, 60.0, 0.0, 100.0, 10.0, "b", "x"), (1, 0, 0.0, 0.0, 40.0, 10.0, "a", "x"), (1, 0, 0.0, 12.0, 40.0, 20.0, "c", "x"), (1, 1, 0.0, 0.0, 1.0, 1.0, "next", "x")]
    rows += [(1, 0, None, 0.0, 1.0, 1.0, "no side", "x"), (1, 0, float("nan"), 0.0, 1.0, 1.0, "no side", "x"), (2, 0, 0.0, 0.0, 1.0, 1.0, None, "x"), (None, 0, 0.0, 0.0, 1.0, 1.0, "null", "x"), (3, 0, 0.0, 0.0, 1.0, 1.0, "r", "x"), (3, 0, 0.0, 0.0, 1.0, 1.0, "r", "x")]
    spans = spark.createDataFrame(rows, SPANS)
    texts = lambda **pdf: {r["doc_id"]: r["text"] for r in pipelines.paper_texts(spans, load(options={"pdf": pdf})).collect()}
    assert texts() == {1: "a\nc\nb\nnext", None: "null", 3: "r\nr"}
    assert texts(reading_order="off", max_pages=1) == {1: "a\nb\nc", None: "null", 3: "r\nr"}
    assert layout.page_texts(spans.where("false")).collect() == []
    with pytest.raises(ValueError, match="xycut or off"):
        layout.page_texts(spans, "other")


def plain_follow(edges):
    out = {}
    for url in edges:
        at, hops, seen = edges[url], 1, {url}
        while at in edges and at not in seen:
            seen.add(at)
            at, hops = edges[at], hops + 1
        out[url] = (None, None, True) if at in edges else (at, hops, False)
    return out


def test_redirects(spark):
    rng = random.Random(3)
    edges = {f"n{i}": f"n{rng.randrange(400)}" for i in range(300) if i % 11}
    edges |= {f"c{i}": f"c{i + 1}" for i in range(129)} | {f"r{i}": f"r{(i + 1) % 37}" for i in range(37)} | {"t1": "t0", "t0": "r5", "self": "self"}
    rows = [(u, t, 1) for u, t in edges.items()] + [("c5", "zzz", 1), ("c5", "c6", 2), (None, "x", 1), ("gone", None, 1)]
    got = {r["url"]: (r["final"], r["hops"], r["cyclic"]) for r in redirects.followed(spark.createDataFrame(rows, "url string, target string, hops int")).collect()}
    assert got == plain_follow(edges)
    assert redirects.followed(spark.createDataFrame([], "url string, target string")).collect() == []


def test_short_links_of_many_hops(spark):
    hops = [("https://t.co/a", "https://t.co/b"), ("https://t.co/b", "http://end"), ("https://t.co/c", "https://t.co/c")]
    ends = redirects.followed(spark.createDataFrame(hops, "url string, target string")).where("NOT cyclic")
    docs = spark.createDataFrame([(1, "see https://t.co/a and https://t.co/c")], "doc_id int, text string")
    assert expand_links(docs, ends.selectExpr("url AS short", "final AS target")).first()["text"] == "see http://end and https://t.co/c"


def test_calls_in_order_and_bounded():
    lock, now, most = threading.Lock(), [0], [0]

    def call(i):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.002 * (7 - i % 7))
        with lock:
            now[0] -= 1
        return i

    began = time.time()
    assert list(connectors.in_order(((lambda i=i: call(i)) for i in range(60)), 6)) == list(range(60))
    assert 2 <= most[0] <= 6 and time.time() - began < 60 * 0.008
    assert list(connectors.in_order([], 3)) == []
    with pytest.raises(ZeroDivisionError):
        list(connectors.in_order([lambda: 1, lambda: 1 // 0], 2))


class Slow:
    """Writes a file for each call, tells how many ran at once in its process, and is slower with shorter prompts."""

    def __init__(self, folder):
        self.folder = folder

    def complete(self, system, user, image=None, media_type=None):
        mine = Path(self.folder) / f"{time.time_ns()}-{threading.get_ident()}"
        mine.write_text(user)
        running = sum(t.name.startswith("ThreadPoolExecutor") for t in threading.enumerate())
        time.sleep(0.03 if len(user) < 3 else 0.01)
        return ("rate limit" if user == "bad" else f"<{user}|{image and bytes(image).decode()}>"), running, 0


def test_equal_questions_are_asked_once(spark, tmp_path):
    rows = [(i, f"q{i % 9}") for i in range(200)] + [(300, None), (301, ""), (302, "bad"), (303, "bad")]
    work = spark.createDataFrame(rows, "doc_id int, message string").repartition(4)
    got = {r["doc_id"]: (r["answer"], r["error_message"]) for r in connectors.answered(work, Slow(str(tmp_path)), "s", limits={"requests": 10_000}, in_flight=3).collect()}
    assert got == {i: ((None, None) if m is None else (None, "error pattern: rate limit") if m == "bad" else (f"<{m}|None>", None)) for i, m in rows}
    assert sorted(p.read_text() for p in tmp_path.iterdir()) == sorted({m for _, m in rows if m is not None})


def test_pictures_are_described_at_once(spark, tmp_path):
    rows = [(1, f"m{i}", bytearray(str(i).encode()), "image/png", "l", f"a{i}") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id int, position_marker string, image_bytes binary, media_type string, source_label string, alt_text string").coalesce(1)
    got = {r["position_marker"]: r["description"] for r in connectors.described(df, Slow(str(tmp_path)), user="{alt}", limits={"requests": 1000}).collect()}
    assert got == {f"m{i}": f"<a{i}|{i}>" for i in range(12)}


def test_lines_of_a_column_are_not_cut_again(monkeypatch):
    """A head and three columns of forty lines take a projection on each axis for the page, the columns and each column."""
    import numpy as np

    from loomtext.operators import layout

    asked, real = [], layout._gaps
    monkeypatch.setattr(layout, "_gaps", lambda low, high: asked.append(len(low)) or real(low, high))
    lines = [(c * 200.0, 50.0 + i * 12, c * 200.0 + 180, 60.0 + i * 12) for c in range(3) for i in range(40)]
    assert layout.cut_order(np.array([(0.0, 10.0, 580.0, 30.0), *lines])).tolist() == list(range(121))
    assert len(asked) == 10 and layout.cut_order(np.empty((0, 4))).tolist() == []
