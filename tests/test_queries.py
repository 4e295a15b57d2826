"""Every query against its SQL on the smallest tables, and the driver's contract."""

import duckdb
import pytest

import __spark_entry__ as entry
from loomtext import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, db, name):
    got, want = queries.QUERIES[name](spark, SF), db.sql(queries.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    places = [want.columns.index(c) for c in order]
    assert sorted(repr(tuple(r[c] for c in order)) for r in got.collect()) == sorted(repr(tuple(r[i] for i in places)) for r in want.fetchall())


def test_long_conversations_and_lines_that_turns_share(spark, tmp_path):
    """Stamps of a hundred hours and more, in fixtures and readers, and turns with a line of the turn before."""
    rows = [(c, t, "user", f"turn {t}.") for c in (0, 2, 4) for t in range(207)] + [(5, 0, "user", "One.\nTwo."), (5, 1, "assistant", "Two.\nThree."), (6, 0, "user", "A."), (6, 1, "assistant", "A.\nB.")]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    for name in ("subtitle_cues", "transcript_markdown"):
        got, want = queries.QUERIES[name](spark, str(tmp_path)), con.sql(queries.ORACLES[name])
        assert sorted(repr(tuple(r[c] for c in want.columns)) for r in got.collect()) == sorted(map(repr, want.fetchall()))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(queries.QUERIES) <= set(entry.queries())


def test_entry_without_the_other_subpackage(monkeypatch):
    import builtins

    real = builtins.__import__

    def refuse(name, *args, **kwargs):
        if name.startswith(("loomtext.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name, name=name)
        return real(name, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", refuse)
    monkeypatch.setattr(entry.importlib, "import_module", refuse)
    assert set(entry.queries()) == set(queries.QUERIES) and set(entry.oracle_sql()) == set(queries.ORACLES)


def test_chunks_to_polish_are_cut_once(spark):
    """They are read three times, as work, for their answers and to be counted, from a table and not from Python workers."""
    plan = queries.QUERIES["polish_chunks"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan and "Relation" in plan


def _odd(spark, folder, name, **tables):
    """A query over tables given as (schema, rows), and the same in SQL."""
    con = duckdb.connect()
    for table, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got, want = queries.QUERIES[name](spark, str(folder)), con.sql(queries.ORACLES[name])
    shown = sorted(repr(tuple(r[c] for c in want.columns)) for r in got.collect())
    assert shown == sorted(map(repr, want.fetchall()))
    return shown


DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
TURNS = "conv_id bigint, turn bigint, role string, text string"


def test_sizes_of_previews(spark, tmp_path):
    """Files of a million bytes and more, by the operator as the reference writes them, by the query as its SQL does."""
    from loomtext.plans import pipelines

    files = spark.createDataFrame([("/d/a.md", 999), ("/d/b.md", 1000988), ("/d/c.md", 1234567890)], "path string, length bigint")
    assert [r["bytes"] for r in pipelines.preview_files(files).collect()] == ["999", "1,000,988", "1,234,567,890"]
    rows = [(k,) for k in (1, 2, 1003, 1004, 60000, 1500000)]
    shown = _odd(spark, tmp_path, "previews", supplier=("s_suppkey bigint", rows), documents=(DOCUMENTS, [(0, "a", "en", "web", 1)]), conversations=(TURNS, [(1, 0, "user", "a")]))
    assert any("|1000,988|" in x for x in shown)


def test_lines_of_local_documents_that_look_like_headings(spark, tmp_path):
    """In capitals, before a colon, behind `#` or dashes, as markup and in quotes, in files of each kind. The reader's rule stays."""
    from loomtext.sources import files

    text = [("/d/a.txt", b"LYESSH.\none\nNote:\ntwo")]
    read = files.text_documents(spark.createDataFrame(text, "path string, content binary").selectExpr("path AS doc_id", "path", "content", "timestamp '2024-05-06' AS modified"))
    assert [(s["heading"], s["body"]) for s in read.first()["sections"]] == [("LYESSH.", "one"), ("Note", "two")]
    lines = ["LYESSH.", "A B C", "Note that:", "ABC:", "# head", "--- a --- b", "«quoted»", "a<b>c & d&lt", "PART ONE", "一二三四:", "plain  text"]
    texts = ["\n".join(x) for x in [(a,) for a in lines] + [(a, b) for a in lines for b in ("", *lines)]]
    rows = [(i * 7 + k, text, "en", "web", len(text)) for i, text in enumerate(texts) for k in range(7)]
    assert len(_odd(spark, tmp_path, "local_documents", documents=(DOCUMENTS, rows))) == len(rows)


PAGES = "page_id bigint, url string, html string"
#: Ends of texts that were cut after they were escaped, and references that the SQL leaves as they are.
ENDS = ["&quot", "&quo", "&q", "&amp", "&am", "&", "&copy", "&middot", "&quotx", "&ampx", "&notit", "&lt;", "&gt", "&#39;", "&nbsp;", "&quot;", "&copy;", "&amp;amp;", "&amp;#39;", "&AMP;"]


def _cut_pages():
    page = lambda k, e: f'<html lang="en"><head><title>About a word {e}</title></head><body><article><h1>About a word {e}</h1><p>{"One more word of a text. " * 9}{e}</p><p>A <a href="/x?a=1&amp;b=2&copy=3">link{e} </a>{e}</p></article></body></html>'
    return [(k, f"http://h{k}.org/a", page(k, e)) for k, e in enumerate(ENDS)]


def test_cut_references_in_articles(spark, tmp_path):
    """Titles, heads and texts that end within a reference, by the query as its SQL reads them, by the reader as HTML does."""
    from loomtext.sources import web

    assert [web.read_page(html)["title"] for _, _, html in _cut_pages()[:3]] == ['About a word "', "About a word &quo", "About a word &q"]
    assert len(_odd(spark, tmp_path, "article_markdown", pages=(PAGES, _cut_pages()))) == len(ENDS)


def test_cut_references_in_previews_of_articles(spark, tmp_path):
    shown = _odd(spark, tmp_path, "article_preview", pages=(PAGES, _cut_pages()))
    assert sum("About a word &quot'" in x for x in shown) == 1


def test_cut_references_in_pages_read_by_density(spark, tmp_path):
    assert len(_odd(spark, tmp_path, "page_density", pages=(PAGES, _cut_pages()))) == len(ENDS)


def test_first_lines_of_pages_with_images(spark, tmp_path):
    """Blank ones, those that hold markup or references, long ones, and documents that share an id."""
    lines = ["", " ", "\t ", "T", "x & y", "cut&quot", "a&copy=1", "AT&T", "1 < 2", "a<b>c", "</p></article>", "&&& &amp; x", "word " * 40, " padded ", "after"]
    rows = [(i, text, "en", "web", len(text)) for i, text in enumerate([*lines, *(a + "\nnext" for a in lines)])] + [(7, "Again.", "en", "web", 6), (99, None, "en", "web", 0)]
    assert len(_odd(spark, tmp_path, "page_images", documents=(DOCUMENTS, rows))) == 4 * (len(lines) - 3) + 2
    plan = queries.QUERIES["page_images"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
