"""Settings: defaults, a file over them, options over both. Unknown keys are left out, lists are replaced."""

from __future__ import annotations

import argparse
import json
import os
from dataclasses import asdict, dataclass, field, fields, is_dataclass


# Settings by group, with their defaults.
@dataclass(frozen=True)
class Output:
    dir: str = "content"
    slug_max_length: int = 80
    overwrite: bool = False


@dataclass(frozen=True)
class Subtitles:
    lang: str | None = None
    prefer_auto: bool = False


@dataclass(frozen=True)
class Auth:
    cookies_from_browser: str | None = None
    cookies: str | None = None


@dataclass(frozen=True)
class Network:
    retries: int = 3
    backoff_base: int = 2


@dataclass(frozen=True)
class Whisper:
    enabled: bool = True
    model: str = "large-v3"
    device: str = "auto"
    beam_size: int = 5
    vad_filter: bool = True
    audio_quality: str = "0"


@dataclass(frozen=True)
class RateLimit:
    tpm: int = 150_000
    rpm: int = 100
    threshold: float = 0.8


@dataclass(frozen=True)
class Polish:
    chunk_size_cjk: int = 500
    chunk_size: int = 1000
    context_ratio: float = 0.1


@dataclass(frozen=True)
class Llm:
    model: str | None = None
    polish_model: str | None = None
    max_workers: int = 8
    timeout: int = 120
    rate_limit: RateLimit = field(default_factory=RateLimit)
    polish: Polish = field(default_factory=Polish)
    error_patterns: tuple[str, ...] = ("rate limit", "overloaded")


@dataclass(frozen=True)
class Text:
    cjk_threshold: float = 0.3
    paragraph_gap_seconds: float = 4.0
    sentence_break_count: int = 6


@dataclass(frozen=True)
class Flags:
    no_chapters: bool = False
    include_description: bool = False


@dataclass(frozen=True)
class Articles:
    enabled: bool = True
    timeout: int = 30
    user_agent_rotation: bool = True
    verify_ssl: bool = True
    include_tables: bool = True
    include_links: bool = False
    include_images: bool = False
    min_content_length: int = 100


@dataclass(frozen=True)
class Pdf:
    enabled: bool = True
    timeout: int = 60
    user_agent_rotation: bool = True
    verify_ssl: bool = True
    min_content_length: int = 200
    include_abstract: bool = True
    strip_references: bool = False
    max_pages: int = 0
    table_method: str = "default"
    reading_order: str = "xycut"
    use_struct_tree: bool = True
    image_format: str = "png"
    include_header_footer: bool = False


@dataclass(frozen=True)
class LocalFiles:
    enabled: bool = True
    min_content_length: int = 50
    include_tables: bool = True
    detect_txt_headings: bool = True
    include_speaker_notes: bool = True


@dataclass(frozen=True)
class Podcast:
    enabled: bool = True
    max_episodes: int = 10
    prefer_rss: bool = True


@dataclass(frozen=True)
class Twitter:
    enabled: bool = True
    nitter_instance: str = "nitter.poast.org"
    nitter_fallback_instances: tuple[str, ...] = ("nitter.privacydev.net", "nitter.woodland.cafe")
    timeout: int = 30
    user_agent_rotation: bool = True
    verify_ssl: bool = True
    expand_tco_links: bool = True
    syndication_enabled: bool = True


@dataclass(frozen=True)
class Vision:
    enabled: bool = True
    max_images: int = 20
    min_width: int = 50
    min_height: int = 50
    min_bytes: int = 5000
    model: str | None = None
    max_workers: int = 4
    timeout: int = 120


@dataclass(frozen=True)
class Markitdown:
    enabled: bool = True
    llm_enabled: bool = False
    llm_model: str | None = None


@dataclass(frozen=True)
class Config:
    output: Output = field(default_factory=Output)
    subtitles: Subtitles = field(default_factory=Subtitles)
    auth: Auth = field(default_factory=Auth)
    network: Network = field(default_factory=Network)
    whisper: Whisper = field(default_factory=Whisper)
    llm: Llm = field(default_factory=Llm)
    text: Text = field(default_factory=Text)
    flags: Flags = field(default_factory=Flags)
    articles: Articles = field(default_factory=Articles)
    pdf: Pdf = field(default_factory=Pdf)
    local_files: LocalFiles = field(default_factory=LocalFiles)
    podcast: Podcast = field(default_factory=Podcast)
    twitter: Twitter = field(default_factory=Twitter)
    vision: Vision = field(default_factory=Vision)
    markitdown: Markitdown = field(default_factory=Markitdown)
    urls: tuple[str, ...] = ()


# Flat keys of an older file, and where they are now. `no_whisper` says the opposite.
FLAT_KEYS = {
    "prefer_auto": ("subtitles", "prefer_auto"), "no_chapters": ("flags", "no_chapters"), "include_description": ("flags", "include_description"), "no_whisper": ("whisper", "enabled"),
    "cookies_from_browser": ("auth", "cookies_from_browser"), "cookies": ("auth", "cookies"), "lang": ("subtitles", "lang"), "retries": ("network", "retries"),
    "whisper_model": ("whisper", "model"), "whisper_device": ("whisper", "device"), "model": ("llm", "model"), "polish_model": ("llm", "polish_model"),
}


def merged(base: dict, over: dict) -> dict:
    both = {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}
    return base | both


def nested(flat: dict) -> dict:
    """The older file's flat keys by group; keys that it does not know are left out, a lone URL becomes a list."""
    flat, out = dict(flat), {}
    old = flat.pop("cookie_args", None) or []
    if "cookies_from_browser" not in flat and "--cookies-from-browser" in old[:-1]:
        flat["cookies_from_browser"] = old[old.index("--cookies-from-browser") + 1]
    for key, value in flat.items():
        if key == "urls":
            out["urls"] = value if isinstance(value, list) else [value]
        elif key in FLAT_KEYS:
            group, name = FLAT_KEYS[key]
            out.setdefault(group, {})[name] = not value if key == "no_whisper" else value
    return out


def is_flat(given: dict) -> bool:
    """Whether a file is of the older kind: no key of it is a group."""
    return bool(given) and not any(isinstance(v, dict) for v in given.values())


def cookie_args(config: Config, default_file: str | None = None) -> list[str]:
    """A video tool's arguments: cookies of a browser, else of the file named, else of a default file if there is one."""
    if config.auth.cookies_from_browser:
        return ["--cookies-from-browser", config.auth.cookies_from_browser]
    found = config.auth.cookies or (default_file if default_file and os.path.exists(default_file) else None)
    return ["--cookies", found] if found else []


def enabled(config: Config) -> tuple[str, ...]:
    """Kinds of content that the settings let through."""
    switch = {"pdf": config.pdf.enabled, "local_file": config.local_files.enabled, "podcast": config.podcast.enabled, "twitter": config.twitter.enabled, "article": config.articles.enabled}
    return tuple(k for k in ("youtube", "podcast", "pdf", "local_file", "twitter", "article") if switch.get(k, True))


def _made(kind, given: dict):
    known = {f.name: f for f in fields(kind)}
    values = {k: _made(known[k].default_factory, v) if isinstance(v, dict) and is_dataclass(known[k].default_factory) else tuple(v) if isinstance(v, list) else v for k, v in given.items() if k in known}
    return kind(**values)


def load(path: str | None = None, options: dict | None = None) -> Config:
    """JSON, or YAML where a reader for it is installed; options win over the file, the file over the defaults."""
    given: dict = {}
    if path:
        with open(path, encoding="utf-8") as f:
            text = f.read()
        try:
            given = json.loads(text)
        except ValueError:
            import yaml

            given = yaml.safe_load(text) or {}
    return _made(Config, merged(merged(asdict(Config()), nested(given) if is_flat(given) else given), options or {}))


# Options of the command line, where they are in the settings, and what a flag sets.
OPTIONS = {
    "output_dir": ("output", "dir", str), "overwrite": ("output", "overwrite", True), "lang": ("subtitles", "lang", str), "prefer_auto": ("subtitles", "prefer_auto", True), "cookies_from_browser": ("auth", "cookies_from_browser", str),
    "cookies": ("auth", "cookies", str), "retries": ("network", "retries", int), "no_whisper": ("whisper", "enabled", False), "whisper_model": ("whisper", "model", str), "whisper_device": ("whisper", "device", str), "polish_model": ("llm", "polish_model", str),
    "no_chapters": ("flags", "no_chapters", True), "include_description": ("flags", "include_description", True), "no_abstract": ("pdf", "include_abstract", False), "strip_references": ("pdf", "strip_references", True), "max_pages": ("pdf", "max_pages", int),
    "max_episodes": ("podcast", "max_episodes", int), "nitter_instance": ("twitter", "nitter_instance", str), "no_speaker_notes": ("local_files", "include_speaker_notes", False), "no_images": ("vision", "enabled", False),
}


def parser() -> argparse.ArgumentParser:
    """Options of the command line: those of OPTIONS, inputs, a list file, a settings file, dry run and backfill."""
    p = argparse.ArgumentParser(prog="loomtext", description="Texts of files, pages, papers, feeds, videos and posts as Markdown documents.")
    p.add_argument("urls", nargs="*", help="URLs, files or folders")
    p.add_argument("-f", "--file", help="a file with one URL a line")
    p.add_argument("--config", help="a settings file, JSON or YAML")
    p.add_argument("--service", action="append", default=[], help="kind=module:attribute of a service")
    p.add_argument("--dry-run", action="store_true", help="tell what would be done")
    p.add_argument("--backfill-batch", action="store_true", help="copy the documents of all folders to the batch folder")
    for name, (group, key, kind) in OPTIONS.items():
        flag = ["-o"] if name == "output_dir" else []
        how = {"type": kind, "default": None} if isinstance(kind, type) else {"action": "store_true"}
        p.add_argument(*flag, f"--{name.replace('_', '-')}", help=f"{group}.{key}", **how)
    return p


def overrides(args: argparse.Namespace) -> dict:
    """The options that were given, by group; given inputs take the place of those in the settings."""
    out: dict = {"urls": list(args.urls)} if args.urls else {}
    for name, (group, key, kind) in OPTIONS.items():
        given = getattr(args, name)
        if given is not None and given is not False:
            out.setdefault(group, {})[key] = given if isinstance(kind, type) else kind
    return out


def template() -> str:
    """All settings with their defaults, as a file to begin with."""
    return json.dumps(asdict(Config()), indent=2)
