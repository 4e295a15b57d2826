"""Pictures behind their anchors, against one find after the other, and documents as files of their own."""

import random
import time

import pytest
from pyspark.sql import functions as F

from loomtext.operators import anchors as A
from loomtext.plans import document_files, sinks
from loomtext.runtime import ship

SECTIONS = "array<struct<seq:bigint,heading:string,level:int,body:string>>"


def plain(sections, pictures):
    """As a loop of finds does it, where one sign stands for what was put in."""
    bodies, after, left = [s["body"] or "" for s in sections], {}, []
    for p in pictures:
        if not p["description"]:
            continue
        text = chr(0xE000 + p["seq"])
        for i, body in enumerate(bodies):
            at = body.find(p["anchor"], after.get((i, p["anchor"]), 0)) if p["anchor"] else -1
            if at >= 0:
                end = at + len(p["anchor"])
                bodies[i] = body[:end] + text + body[end:]
                for key in [k for k in after if k[0] == i and after[k] >= end and k[1] != p["anchor"]]:
                    after[key] += len(text)
                after[i, p["anchor"]] = end + len(text)
                break
        else:
            left.append("> [Image: " + p["description"].strip() + "]")
    for p in pictures:
        bodies = [b.replace(chr(0xE000 + p["seq"]), f"\n\n> [Image: {(p['description'] or '').strip()}]\n") for b in bodies]
    out = [s | {"body": b} if b != (s["body"] or "") else s for s, b in zip(sections, bodies)]
    return out + ([{"seq": max((s["seq"] for s in sections), default=-1) + 1, "heading": "Figures", "level": 2, "body": "\n\n".join(left)}] if left else [])


def test_against_finds():
    rng = random.Random(4)
    for _ in range(3000):
        sections = [{"seq": i, "heading": "h", "level": 2, "body": rng.choice([None, "", "".join(rng.choices("ab é", k=rng.randrange(30)))])} for i in range(rng.randrange(4))]
        pictures = [{"seq": i, "anchor": rng.choice([None, "", "".join(rng.choices("ab é", k=rng.randrange(1, 4)))]), "description": rng.choice([None, "", "X", " Y\n", "Z"])} for i in range(rng.randrange(7))]
        assert A.filled(sections, pictures)[0] == plain(sections, pictures)


def test_long_body_and_many_pictures():
    body = "word " * 200_000
    pictures = [{"seq": i, "anchor": "word ", "description": str(i)} for i in range(2000)]
    out, places = A.filled([{"seq": 0, "heading": "", "level": 2, "body": body}], pictures)
    assert len(out) == 1 and [p["at"] for p in places] == [5 * (i + 1) for i in range(2000)]


def test_documents_and_places(spark):
    ship(spark)
    docs = spark.createDataFrame([(1, [(0, "", 2, "one two"), (1, "b", 2, "two one")], "x"), (2, [(0, "", 2, "none")], "y"), (3, None, "z"), (4, [], "w")], f"doc_id int, sections {SECTIONS}, pictures_ string")
    pictures = spark.createDataFrame([(1, 2, "two", "c"), (1, 0, "two", "a"), (1, 1, "two", "b"), (1, 3, "one", None), (3, 0, "x", "lost"), (9, 0, "x", "no document")], "doc_id int, seq int, anchor_text string, description string")
    got = {r["doc_id"]: r for r in A.insert_at_anchors(docs.drop("pictures_").withColumn("extra", F.lit(1)), pictures).collect()}
    assert [s["body"] for s in got[1]["sections"]] == ["one two\n\n> [Image: a]\n", "two\n\n> [Image: b]\n one", "> [Image: c]"]
    assert [(p["seq"], p["section"], p["at"]) for p in got[1]["image_places"]] == [(0, 0, 7), (1, 1, 3), (2, None, None)]
    assert got[2]["sections"][0]["body"] == "none" and got[2]["image_places"] is None and got[2]["extra"] == 1
    assert [s["heading"] for s in got[3]["sections"]] == ["Figures"] and got[4]["sections"] == []
    there = A.anchored(docs, pictures).select("doc_id", "seq", "section", "at").collect()
    assert sorted(map(tuple, there)) == [(1, 0, 0, 7), (1, 1, 1, 3), (1, 3, 0, 3)]


# Files ------------------------------------------------------------------------------------------------------------------


def files(folder):
    return {str(p.relative_to(folder)): p.read_text() for p in folder.rglob("*") if p.is_file() and not p.name.startswith(".")}


def frame(spark, rows):
    return spark.createDataFrame(rows, "path string, basename string, markdown string")


def test_a_file_for_each_document(spark, tmp_path):
    out = tmp_path / "o ut é"
    rows = [("a", "article", "A\n"), ("b%20", "tweet", ""), ("deep/er", "paper", "é" * 10), (None, "x", "y"), ("n", None, "y"), ("m", "x", None)]
    sinks.write_files(frame(spark, rows).repartition(3), str(out), copies=True)
    want = {"a/article.md": "A\n", "b%20/tweet.md": "", "deep/er/paper.md": "é" * 10}
    copies = {f"batch-process/{p.rpartition('/')[0]}.md": t for p, t in want.items()}
    assert files(out) == want | copies
    sinks.write_files(frame(spark, [(p, b, "other") for p, b, t in rows if t is not None]), str(out))
    assert files(out) == want | copies
    sinks.write_files(frame(spark, [("a", "article", "new"), ("c", "article", "more")]), str(out), overwrite=True)
    assert files(out) == want | copies | {"a/article.md": "new", "c/article.md": "more"}
    read = {(r["folder"], r["name"]): r["markdown"] for r in sinks.read_files(spark, f"file://{out}").collect()}
    assert {f"{f}/{n}": t for (f, n), t in read.items()} == files(out)
    plainly = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(str(out)).collect()
    assert {r["path"].partition("o ut é/")[2]: bytes(r["content"]).decode() for r in plainly} == {k: v for k, v in files(out).items() if v}  # Spark gives no rows for empty files
    sinks.write_files(frame(spark, []), str(tmp_path / "empty"))
    assert not (tmp_path / "empty").exists() or files(tmp_path / "empty") == {}


def test_files_of_one_folder_are_written_and_read_by_several_tasks(spark, tmp_path):
    """Documents of one partition, with their copies in one folder, beside nested folders and what is no document."""
    out = tmp_path / "o"
    rows = [(f"d{i}", "x", f"text {i}") for i in range(300)]
    spark.sparkContext.setJobGroup("files", "files")
    sinks.write_files(frame(spark, rows).coalesce(1), str(out), copies=True)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    told = spark.sparkContext.statusTracker()
    stages = [told.getStageInfo(s) for j in told.getJobIdsForGroup("files") for s in told.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) >= spark.sparkContext.defaultParallelism
    for at, text in {"a/b/c/deep.md": "deep", "a/b/.own.md": "own", "top.md": "top", "a/no.txt": "no", ".hidden/x.md": "no"}.items():
        (out / at).parent.mkdir(parents=True, exist_ok=True)
        (out / at).write_text(text)
    (out / "empty").mkdir()
    read = sinks.read_files(spark, str(out)).withColumn("task", F.spark_partition_id()).collect()
    want = {(p, "x.md"): t for p, _, t in rows} | {("batch-process", f"{p}.md"): t for p, _, t in rows}
    assert {(r["folder"], r["name"]): r["markdown"] for r in read} == want | {("a/b/c", "deep.md"): "deep", ("a/b", ".own.md"): "own", ("", "top.md"): "top"}
    assert len(read) == 603 and len({r["task"] for r in read if r["folder"] == "batch-process"}) > 1


@pytest.mark.parametrize("path", ["../up", "/abs", "a//b", "."])
def test_places_that_lead_out(spark, tmp_path, path):
    with pytest.raises(Exception, match="not a place for a document"):
        sinks.write_files(frame(spark, [(path, "x", "y")]), str(tmp_path / "o"))
    assert files(tmp_path) == {}


def test_a_job_that_fails_leaves_nothing(spark, tmp_path):
    """Some tasks have moved their files when another fails for good: they go again, and older files stay."""
    out = tmp_path / "o"
    sinks.write_files(frame(spark, [("old", "x", "kept")]), str(out))
    bad = spark.range(0, 40, 1, 8).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("path"), F.lit("x").alias("basename"), F.when(F.col("id") == 39, F.raise_error(F.lit("gone"))).otherwise(F.lit("text")).alias("markdown"))
    with pytest.raises(Exception, match="gone"):
        sinks.write_files(bad, str(out))
    for _ in range(50):  # tasks that still run undo their own
        if files(out) == {"old/x.md": "kept"}:
            break
        time.sleep(0.1)
    assert files(out) == {"old/x.md": "kept"}


def test_files_of_tasks_that_were_tried_again_go_too(tmp_path):
    """A task that died after its moves has left its list, which abort() reads, whether or not it sent a message."""
    writer = document_files.DocumentWriter(str(tmp_path), False, False)
    staging = tmp_path / f".staging-{writer.job}" / "3-77"
    staging.mkdir(parents=True)
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.md").write_text("half a job")
    (staging / "made").write_text(f'["{tmp_path}/d/x.md", "{tmp_path}/never/y.md"]')
    writer.abort([None])
    assert files(tmp_path) == {} and not staging.exists()
