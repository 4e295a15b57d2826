"""Settings that act: a run over recorded services, and what is told of settings without effect."""

import io
import json
import zipfile
from dataclasses import asdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomtext import __main__ as cli
from loomtext.operators import relational as R
from loomtext.plans import config, pipelines, runs
from loomtext.runtime import ship
from loomtext.sources import connectors, fetching, files

TEXT = "A paragraph of the article that goes on for quite a while, so that it is long enough to be kept. "
PICTURE = b"\x89PNG" + b"x" * 6000
ANSWERS = {
    "http://a.org/1": f"<html><title>One</title><body><article><h1>One</h1><p>{TEXT}{TEXT}</p><table><tr><td>cell</td></tr></table><img src='http://a.org/p.png'></article></body></html>".encode(),
    "http://a.org/p.png": PICTURE,
    "http://arxiv.org/x.pdf": b"%PDF",
    "http://feeds.pod.org/show/rss": b"<rss><channel><title>Show</title><item><title>Ep</title><enclosure url='http://pod.org/1.mp3' type='audio/mpeg'/></item></channel></rss>",
}


class Web:
    def get(self, url):
        found = ANSWERS.get(url)
        return connectors.Answer(404) if found is None else connectors.Answer(200, found, "image/png" if url.endswith(".png") else "text/html")


class Tool:
    def metadata(self, url):
        if "private" in url:
            raise connectors.ToolFailure("ERROR: Private video. Sign in")
        if "feeds" in url:
            raise connectors.ToolFailure("no such thing")
        return json.dumps({"id": "v", "title": "A video", "subtitles": {"en": []} if "subs" in url else {}, "duration": 60})

    def subtitles(self, url, lang, is_auto):
        return {"v.en.vtt": "WEBVTT\n\n00:00:01.000 --> 00:00:02.000\nHello from the video.\n"}

    def audio(self, url):
        return b"sound"


class Speech:
    def transcribe(self, audio, language):
        return [(0.0, 1.0, "Heard words.")], "en"


class Layout:
    def convert(self, content, pages):
        return f"# Paper\n\n{TEXT * 4}\n\npages {pages}\n", json.dumps({"number_of_pages": 2, "title": "P", "author": "", "creation_date": ""}), {}


class Looks:
    def complete(self, system, user, image=None, media_type=None):
        return f"seen {len(image)}", 1, 1


class Polishes:
    def complete(self, system, user, image=None, media_type=None):
        return "POLISHED " + user, 1, 1


def done(spark, urls, services, **options):
    ship(spark)
    cfg = config.load(options={"network": {"retries": 1, "backoff_base": 0}} | options)
    items = R.routed(spark.createDataFrame(list(enumerate(urls)), "pos bigint, url string"))
    return {r["url"]: r for r in pipelines.run(items, runs.plans(cfg, services), cfg).collect()}


ALL = runs.Services(Web(), Tool(), Speech(), Layout(), None, Looks())


def test_all_kinds(spark):
    got = done(spark, ["http://a.org/1", "http://gone.org/", "http://arxiv.org/x.pdf", "https://youtu.be/subs", "https://youtu.be/silent", "https://youtu.be/private", "http://feeds.pod.org/show/rss"], ALL)
    page = got["http://a.org/1"]["markdown"]
    assert "cell" in page and f"> [Image: seen {len(PICTURE)}]" in page
    assert (got["http://gone.org/"]["error_type"], got["http://gone.org/"]["error_message"]) == ("NetworkError", "HTTP 404")
    assert "pages None" in got["http://arxiv.org/x.pdf"]["markdown"]
    assert "Hello from the video" in got["https://youtu.be/subs"]["markdown"] and "Heard words" in got["https://youtu.be/silent"]["markdown"]
    assert got["https://youtu.be/private"]["error_type"] == "VideoUnavailableError"
    assert "Heard words" in got["http://feeds.pod.org/show/rss"]["markdown"] and got["http://feeds.pod.org/show/rss"]["title"] == "Ep"


def test_settings_change_the_result(spark):
    urls = ["http://a.org/1", "http://arxiv.org/x.pdf", "https://youtu.be/silent", "https://youtu.be/subs"]
    got = done(spark, urls, runs.Services(Web(), Tool(), Speech(), Layout(), Polishes(), Looks()), vision={"enabled": False}, articles={"include_tables": False}, pdf={"max_pages": 2}, whisper={"enabled": False}, llm={"polish_model": "m"})
    page = got["http://a.org/1"]["markdown"]
    assert "cell" not in page and "[Image" not in page and "pages 0,1" in got["http://arxiv.org/x.pdf"]["markdown"]
    assert got["https://youtu.be/silent"]["error_type"] == "NoSubtitlesError"
    assert "POLISHED" in got["https://youtu.be/subs"]["markdown"] and "polished: true" in got["https://youtu.be/subs"]["markdown"]
    none = done(spark, urls[:1], ALL, vision={"min_bytes": 10_000})
    assert "[Image" not in none["http://a.org/1"]["markdown"]
    assert done(spark, urls[:1], ALL, articles={"enabled": False})["http://a.org/1"]["error_message"] == "this kind of content is switched off"


def test_http_by_settings():
    cfg = config.load(options={"pdf": {"timeout": 7, "verify_ssl": False, "user_agent_rotation": False}})
    assert runs.over(cfg, runs.Services(), "pdf", "pdf") == connectors.Http("pdf", 7.0, False, False)
    assert runs.over(cfg, runs.Services(), "twitter") == connectors.Http("html", 30.0, True, True)
    assert runs.limits(config.load(options={"llm": {"rate_limit": {"tpm": 5}}})) == {"tokens": 5, "requests": 100, "threshold": 0.8}


def test_every_setting_acts_or_is_told():
    """Each setting is read somewhere outside its definition, or without_effect() tells of it."""
    code = "\n".join(p.read_text() for p in Path(runs.__file__).parents[1].rglob("*.py") if p.name != "config.py" and "/llm/" not in str(p))
    told = {f"{g}.{n}" for g, (_, names) in runs.OWN.items() for n in names} | {f"{g}.{n}" for g, names in runs.MISSING.items() for n in names}
    for group, values in asdict(config.Config()).items():
        for name in values if isinstance(values, dict) else ():
            if f"{group}.{name}" not in told and not isinstance(values[name], dict):
                assert f".{name}" in code, f"{group}.{name}"
    cfg = config.load(options={"whisper": {"model": "small"}, "articles": {"include_links": True}, "llm": {"polish_model": "m"}})
    assert runs.without_effect(cfg) == ["articles.include_links", "llm.polish_model (needs the service model)", "whisper.model (needs the service speech)"]
    assert runs.without_effect(cfg, runs.Services(speech=Speech(), model=Polishes())) == ["articles.include_links"]
    assert runs.without_effect(config.Config()) == []


def pptx(notes):
    out = io.BytesIO()
    a, p = "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/presentationml/2006/main"
    shape = lambda t: f"<p:sp xmlns:p='{p}' xmlns:a='{a}'><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:sp>"
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("ppt/slides/slide1.xml", f"<x>{shape('On the slide')}</x>")
        z.writestr("ppt/notesSlides/notesSlide1.xml", f"<x>{shape(notes)}</x>")
    return out.getvalue()


def test_settings_of_files(spark):
    ship(spark)
    rows = [("f/a.pptx", bytearray(pptx("Said aloud"))), ("f/b.html", bytearray(b"<p>few words</p>"))]
    df = spark.createDataFrame(rows, "path string, content binary").withColumns({"doc_id": F.col("path"), "modified": F.lit(None).cast("timestamp")})
    bodies = lambda **own: {r["path"][2:3]: (r["body"], r["error_type"]) for r in pipelines.local_files(df, config.load(options={"local_files": own})).withColumn("path", F.col("doc_id")).collect()}
    assert "Said aloud" in bodies()["a"][0] and bodies()["b"][1] == "LocalFileError"
    assert "Said aloud" not in bodies(include_speaker_notes=False)["a"][0] and bodies(min_content_length=5)["b"][1] is None
    assert files.local_documents(df).count() == 2


def test_command_line_with_services(spark, tmp_path):
    given = ["http://a.org/1", "https://youtu.be/subs", "-o", str(tmp_path), "--retries", "1"]
    named = [f"--service={kind}=tests.test_runs_of_all_kinds:{name}" for kind, name in (("web", "Web"), ("tool", "Tool"), ("vision", "Looks"))]
    got = {r["url"]: r["error_type"] for r in cli.main([*given, *named], spark).collect()}
    assert got == {"http://a.org/1": None, "https://youtu.be/subs": None}
    texts = [p.read_text() for p in (tmp_path / "output").rglob("*.md")]
    assert any("Hello from the video" in t for t in texts) and any("[Image: seen" in t for t in texts)
    with pytest.raises(SystemExit, match="settings without effect: whisper.model"):
        cli.main([*given, "--whisper-model", "small"], spark)
    with pytest.raises(ValueError, match="a service is named as"):
        cli.main([*given, "--service", "else"], spark)


def test_tools_messages(spark):
    calls = []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise connectors.ToolFailure("HTTP Error 503: unable to download")
        return "fine"

    assert connectors.ran(call, 3, 0, sleep=lambda s: None) == "fine" and len(calls) == 3
    with pytest.raises(connectors.Fatal, match="^AuthRequiredError: "):
        connectors.ran(lambda: (_ for _ in ()).throw(connectors.ToolFailure("Sign in to confirm")), 3)
    hops = spark.createDataFrame([("https://t.co/a", "https://t.co/b"), ("https://t.co/b", "http://end")], "url string, target string")
    docs = spark.createDataFrame([(1, "see https://t.co/a")], "doc_id int, text string")
    assert runs.with_long_links(docs, hops).first()["text"] == "see http://end"
    assert runs.with_long_links(docs, hops, config.load(options={"twitter": {"expand_tco_links": False}})).first()["text"] == "see https://t.co/a"
    assert fetching.SYNDICATION.startswith("https://")
