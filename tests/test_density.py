"""Article text by density, against plain loops, and the frame that a host's pages share."""

import random

from pyspark.sql import functions as F

from loomtext.plans import pipelines
from loomtext.runtime import ship
from loomtext.sources import web

BLOCKS = "array<struct<kind:string,level:int,text:string,links:int>>"


def plain_run(blocks):
    """Of all runs the best by sum, then by earlier end, then by length."""
    score = [len(t) - web.LINK_COST * links - (web.BLOCK_COST if k == "p" else 0) for k, _, t, links in blocks]
    runs = [(-sum(score[i : j + 1]), j, -i) for i in range(len(score)) for j in range(i, len(score))]
    best = min(runs, default=(0, 0, 0))
    return blocks[-best[2] : best[1] + 1] if best[0] < 0 else []


def plain_sections(blocks):
    out, heading, level, body = [], "", 2, []
    for kind, depth, text, _ in [*blocks, ("head", 2, "", 0)]:
        if kind == "p":
            body.append(text)
            continue
        if body:
            out.append((len(out), heading, level, "\n\n".join(body)))
        heading, level, body = text, depth, []
    return out or ([(0, "", 2, "\n".join(b[2] for b in blocks))] if blocks else [])


def test_runs_and_sections(spark):
    rng = random.Random(6)
    rows = [(i, [(rng.choice(["p", "p", "head"]), rng.randrange(1, 4), "é" * rng.randrange(45), rng.choice([0, 0, 5, 20])) for _ in range(rng.randrange(9))]) for i in range(400)]
    df = spark.createDataFrame(rows, f"i int, blocks {BLOCKS}")
    got = df.select("i", web.best_run(F.col("blocks")).alias("run"), web.sections_of_blocks(F.col("blocks")).alias("sections")).collect()
    for r in got:
        blocks = dict(rows)[r["i"]]
        assert [tuple(b) for b in r["run"]] == plain_run(blocks)
        assert [tuple(s) for s in r["sections"]] == plain_sections(blocks)


def page(body, url="http://h.org/1"):
    return url, f"<html><body>{body}</body></html>"


def read(spark, pages, **more):
    ship(spark)
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "doc_id int, url string, html string")
    return {r["doc_id"]: r for r in web.articles(df, 0, **more).collect()}


TEXT = "This is a long paragraph of the text itself, which goes on for a while and says something. "
FRAME = "<p>Everything on the pages of this host is ours, and we ask you to keep that in mind when you read.</p>"
LINKS = "".join(f'<li><a href="/{i}">go to page number {i} of our list</a></li>' for i in range(9))


def test_pages_without_an_article(spark):
    pages = [page(f"<ul>{LINKS}</ul><h2>Head {i}</h2><p>{TEXT}{i}</p><p>short {i}</p><p>{TEXT * 2}{i}</p>{FRAME}<ul>{LINKS}</ul>", f"http://H.org/{i}") for i in range(4)]
    pages += [
        page(f"<article><p>{TEXT}</p></article>{FRAME}", "http://h.org/a"),  # has an element, which is taken as it is
        page(f"{FRAME}", "http://h.org/f"),  # nothing but the frame: it stays
        page("<p>tiny</p>", "http://other.org/"),  # no run: all text
        page("", "http://other.org/2"), ("no url", ""), (None, "<p>x</p>"),
        page(f"{FRAME}<p>{TEXT}</p>", "http://third.org/"),  # the frame of another host is no frame here
    ]
    got = read(spark, pages, density=True)
    for i in range(4):
        assert [(s["heading"], s["body"]) for s in got[i]["sections"]] == [(f"Head {i}", f"{TEXT}{i}\n\nshort {i}\n\n{TEXT * 2}{i}")]
    assert got[4]["sections"][0]["body"] == TEXT.strip() and got[5]["sections"][0]["body"].startswith("Everything")
    assert got[6]["sections"][0]["body"] == "tiny" and got[7]["sections"] == [] and got[8]["error_type"] == "ContentExtractionError"
    assert got[9]["sections"][0]["body"] == "x" and len(got[10]["sections"][0]["body"].split("\n\n")) == 2
    assert FRAME[3:40] in read(spark, pages)[0]["sections"][-1]["body"]  # without density all text is taken


def test_copies_of_one_page_stay(spark):
    """All pages of a host are copies: all their blocks repeat, so the best run of all blocks is taken."""
    got = read(spark, [page(f"<ul>{LINKS}</ul><h1>T</h1><p>{TEXT}</p>", f"http://h.org/{i}") for i in range(5)], density=True)
    assert all([(s["heading"], s["body"]) for s in r["sections"]] == [("T", TEXT.strip())] for r in got.values())


def test_plan_of_pages(spark):
    ship(spark)
    df = spark.createDataFrame([(1, "http://h.org/", f"<ul>{LINKS}</ul><h1>T</h1><p>{TEXT * 3}</p>")], "doc_id int, url string, html string")
    pictures = spark.createDataFrame([(1, 0, "says something.", "a cat")], "doc_id int, seq int, anchor_text string, description string")
    made = pipelines.pages(df, described=pictures, density=True)
    assert "says something.\n\n> [Image: a cat]\n This is a long" in made.first()["markdown"]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_read(html") == 2 and plan.count("_filled(") == 1  # one parse of each page, one pass over anchors


def test_workers_read_a_few_texts_at_a_time():
    """What a worker holds does not grow with a batch: twenty large texts come back in many small batches, each row once."""
    import pyarrow as pa

    texts = [f"<doc><p>{i} {'x' * 100_000}</p></doc>" for i in range(19)] + [None]
    parts = list(web._each(web.read_extracted, web._ARROW_EXTRACTED, [pa.record_batch({"doc_id": list(range(20)), "xml": texts})]))
    assert len(parts) > 5 and max(p.num_rows for p in parts) <= 3
    told = [(k, s[0]["body"].split(" ")[0] if s else None) for p in parts for k, s in zip(p.column("doc_id").to_pylist(), p.column("sections").to_pylist())]
    assert told == [(i, str(i)) for i in range(19)] + [(19, None)]
