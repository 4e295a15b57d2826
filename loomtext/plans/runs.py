"""Settings put to work: plans for all kinds of content from a configuration and what a user brings along.

Services are what needs a network, a device or a model: a video tool, speech recognition, a layout converter, language and
vision models. Each may be missing; a kind that cannot do without a missing one has no plan, and its items keep an error.
The web is asked over HTTP by the settings of each kind unless a connector is given.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass, fields
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.operators import chunks as K
from loomtext.operators import images as I
from loomtext.operators import redirects
from loomtext.plans import pipelines, sinks
from loomtext.plans.config import Config
from loomtext.sources import connectors, fetching, structured, web

POLISH = "Correct punctuation, spelling and paragraphs of the transcript. Keep its words and language."


@dataclass(frozen=True)
class Services:
    web: connectors.Connector | None = None
    tool: connectors.Tool | None = None
    speech: connectors.Speech | None = None
    converter: connectors.Converter | None = None
    model: connectors.Model | None = None
    vision: connectors.Model | None = None

    @staticmethod
    def named(names: list[str]) -> Services:
        """Services by `kind=module:attribute`, of which classes are called without arguments."""
        kinds, found = {f.name for f in fields(Services)}, {}
        for name in names:
            kind, _, place = name.partition("=")
            module, _, attribute = place.partition(":")
            if kind not in kinds or not attribute:
                raise ValueError(f"a service is named as kind=module:attribute with a kind of {sorted(kinds)}, not {name!r}")
            made = getattr(importlib.import_module(module), attribute)
            found[kind] = made() if isinstance(made, type) else made
        return Services(**found)


#: Settings that no plan reads, as they are the service's own: a user who changes one without that service is told.
OWN = {
    "auth": ("tool", ("cookies_from_browser",)), "whisper": ("speech", ("model", "device", "beam_size", "vad_filter", "audio_quality")), "llm": ("model", ("model", "timeout")), "vision": ("vision", ("model", "timeout")),
    "pdf": ("converter", ("table_method", "use_struct_tree", "image_format", "include_header_footer")),
}
#: Settings for what is not there: links and pictures as marks within texts, and a general converter before the readers.
MISSING = {"articles": ("include_links", "include_images"), "markitdown": ("llm_enabled", "llm_model")}


def without_effect(cfg: Config, services: Services = Services()) -> list[str]:
    """Settings that differ from their defaults and change nothing with these services."""
    plain, out = Config(), []
    for group, (service, names) in OWN.items():
        if getattr(services, service) is None:
            out += [f"{group}.{n} (needs the service {service})" for n in names if getattr(getattr(cfg, group), n) != getattr(getattr(plain, group), n)]
    for group, names in MISSING.items():
        out += [f"{group}.{n}" for n in names if getattr(getattr(cfg, group), n) != getattr(getattr(plain, group), n)]
    if cfg.llm.polish_model and services.model is None:
        out.append("llm.polish_model (needs the service model)")
    return sorted(out)


def over(cfg: Config, services: Services, group: str, kind: str = "html") -> connectors.Connector:
    """How a kind of content asks the web: the connector given, else HTTP by the settings of its group."""
    own = getattr(cfg, group)
    return services.web or connectors.Http(kind, float(own.timeout), own.verify_ssl, own.user_agent_rotation)


def limits(cfg: Config) -> dict:
    rate = cfg.llm.rate_limit
    return {"tokens": rate.tpm, "requests": rate.rpm, "threshold": rate.threshold}


def described(html: DataFrame, cfg: Config, services: Services) -> DataFrame | None:
    """Descriptions (doc_id, seq, anchor_text, description) of pages' pictures, or None where they are switched off."""
    if not (cfg.vision.enabled and services.vision):
        return None
    v = cfg.vision
    found = web.images_of(web.articles(html, 0, tables=cfg.articles.include_tables), v.min_width)
    got = fetching.images(found, over(cfg, services, "articles", "image"), v.min_bytes)
    sized = got.withColumns({c: F.coalesce(F.col(c).try_cast("int"), F.lit(0)) for c in ("width", "height")})
    small = F.col("height").between(1, v.min_height - 1)
    worth = I.worth_describing(sized.where(~small), v.max_images, v.min_width, v.min_bytes).withColumn("position_marker", I.marker())
    told = connectors.described(worth, services.vision, limits=limits(cfg), in_flight=v.max_workers)
    return worth.select("doc_id", "seq", F.col("alt_text").alias("anchor_text"), "position_marker").join(told, ["doc_id", "position_marker"]).drop("position_marker")


def articles(items: DataFrame, cfg: Config, services: Services) -> DataFrame:
    html = fetching.articles(items, over(cfg, services, "articles"), cfg)
    made = pipelines.pages(html.select("doc_id", "url", F.coalesce("html", F.lit("")).alias("html")), cfg, described(html, cfg, services), density=True)
    fault = html.where("error_type IS NOT NULL").select("doc_id", F.col("error_type").alias("fault"), F.col("error_message").alias("why"))
    made = made.join(fault, "doc_id", "left")
    return made.withColumns({"error_type": F.coalesce("fault", "error_type"), "error_message": F.coalesce("why", "error_message")}).drop("fault", "why")


def papers(items: DataFrame, cfg: Config, services: Services) -> DataFrame:
    files = fetching.pdf_files(items, over(cfg, services, "pdf", "pdf"), cfg)
    got = connectors.converted_pdfs(files.where("content IS NOT NULL"), services.converter, structured.page_range(cfg.pdf.max_pages), cfg.pdf.min_content_length)
    texts = got.where("text IS NOT NULL").select("doc_id", "text").join(items.select("doc_id", "url"), "doc_id")
    api = fetching.papers(items, over(cfg, services, "articles"), cfg)
    return pipelines.papers(texts, got.where("text IS NOT NULL").select("doc_id", "json"), api, cfg)


def videos(items: DataFrame, cfg: Config, services: Services) -> DataFrame:
    meta, files = fetching.subtitles(items, services.tool, cfg)
    heard = None
    if cfg.whisper.enabled and services.speech:
        silent = items.join(files.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "url", F.lit(None).cast("string").alias("language"))
        heard = connectors.transcribed(silent, services.tool, services.speech)
    made = pipelines.videos(meta.where("json IS NOT NULL"), files, cfg, heard)
    lost = meta.where("json IS NULL").select("doc_id", "error_type", "error_message")
    return polished(made, cfg, services).unionByName(lost, allowMissingColumns=True)


def podcasts(items: DataFrame, cfg: Config, services: Services) -> DataFrame:
    """Episodes of all feeds, each a document with its item's id."""
    episodes = fetching.feeds(items, over(cfg, services, "articles"), services.tool, cfg)
    audio = episodes.select(F.col("audio_url").alias("doc_id"), F.col("audio_url").alias("url"), "language").dropDuplicates(["doc_id"])
    nothing = items.sparkSession.createDataFrame([], "audio_url string, seq bigint, start_seconds double, end_seconds double, text string, language string")
    heard = connectors.transcribed(audio, services.tool, services.speech).withColumnRenamed("doc_id", "audio_url") if cfg.whisper.enabled and services.speech else nothing
    made = polished(pipelines.podcasts(episodes, heard, cfg), cfg, services)
    of = items.select(F.col("doc_id").alias("item"), "url").join(episodes.select(F.col("doc_id").alias("url"), F.col("audio_url").alias("audio")).distinct(), "url").select("item", "audio")
    return made.drop("audio_url").withColumnRenamed("doc_id", "audio").join(of, "audio").drop("audio").withColumnRenamed("item", "doc_id")


def posts(items: DataFrame, cfg: Config, services: Services) -> DataFrame:
    ask = over(cfg, services, "twitter")
    told = fetching.syndicated(items, ask, cfg)
    linked = fetching.linked_pages(told.select("doc_id", F.get_json_object("json", "$.text").alias("text")), ask, cfg)
    return pipelines.social(items, told, fetching.embedded(items, ask, cfg), fetching.mirrored(items, ask, cfg), linked=linked, cfg=cfg)


def with_long_links(docs: DataFrame, hops: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Posts' texts (doc_id, text) with short links replaced by where their redirects (url, target) end, if the settings say so."""
    if not cfg.twitter.expand_tco_links:
        return docs
    ends = redirects.followed(hops).where("NOT cyclic").select(F.col("url").alias("short"), F.col("final").alias("target"))
    from loomtext.sources.threads import expand_links

    return expand_links(docs, ends)


def polished(docs: DataFrame, cfg: Config, services: Services) -> DataFrame:
    """Transcripts polished by the language model, where the settings name one; the others, and failures, stay as they are."""
    if not (cfg.llm.polish_model and services.model):
        return docs
    p = cfg.llm.polish
    raw = docs.where("markdown IS NOT NULL").select("doc_id", "markdown")
    work = K.polish_work(raw, p.chunk_size, p.chunk_size_cjk, p.context_ratio)
    asked = work.select("doc_id", "section", "chunk_no", F.concat(F.when(F.col("context") != "", F.concat(F.lit("Before: "), "context", F.lit("\n\n"))).otherwise(""), "chunk").alias("message"))
    answers = connectors.answered(asked, services.model, POLISH, cfg.llm.error_patterns, limits(cfg), cfg.llm.max_workers)
    better = K.polished(raw, work, answers).withColumnRenamed("markdown", "better")
    return docs.join(better, "doc_id", "left").withColumn("markdown", F.coalesce("better", "markdown")).drop("better")


def plans(cfg: Config, services: Services, files: DataFrame | None = None) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """A plan for each kind of content that these services can do, for pipelines.run. files: scanned files (path, content,
    modified) for items that are local."""
    made = {"article": articles, "twitter": posts}
    made |= {"youtube": videos, "podcast": podcasts} if services.tool else {}
    made |= {"pdf": papers} if services.converter else {}
    out = {kind: partial(plan, cfg=cfg, services=services) for kind, plan in made.items()}

    def local(items: DataFrame) -> DataFrame:
        own = files.drop("doc_id").join(items, files["path"] == items["url"]).drop("url")
        return pipelines.local_files(own, cfg)

    return out | ({"local_file": local} if files is not None else {})


def save(done: DataFrame, cfg: Config, out: str) -> None:
    """Documents of a run as files of their own, with copies in the batch folder. Items with an error have no file."""
    folders = sinks.unique_paths(done.where("markdown IS NOT NULL AND error_type IS NULL").withColumn("folder", sinks.folder(max_length=cfg.output.slug_max_length)))
    sinks.write_files(folders.withColumn("basename", sinks.basename()), out, cfg.output.overwrite, copies=True)
