"""What needs a network or a model: interfaces, retries and limits. Recorded answers stand in for them in tests.

A connector is a picklable object with `get(url) -> Answer`; `fetched` runs it over a table, a partition at a time, so
that sessions are opened once in each worker, and failures become columns.
"""

from __future__ import annotations

import gzip
import http.client
import re
import ssl
import threading
import time
import urllib.error
import urllib.request
import zlib
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import partial
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.runtime import ship

# What a video tool's messages mean, in the order in which they are tried.
UNAVAILABLE = ("video unavailable", "private video", "this video has been removed")
AUTHENTICATION = ("sign in", "requires authentication", "members-only", "member", "join this channel")
NETWORK = ("unable to download", "http error", "connection", "urlopen error", "timed out")
TOOL_MESSAGES = tuple((part, what) for parts, what in ((UNAVAILABLE, "VideoUnavailableError"), (AUTHENTICATION, "AuthRequiredError"), (NETWORK, "retry")) for part in parts)
# Headers of requests, and what is asked for by kind.
HEADERS = {"Accept": "text/html,application/xhtml+xml,application/xml;q=0.9,*/*;q=0.8", "Accept-Language": "en-US,en;q=0.9", "Accept-Encoding": "gzip, deflate", "Connection": "keep-alive", "Upgrade-Insecure-Requests": "1"}
ACCEPTED = {"pdf": "application/pdf,*/*", "image": "image/*,*/*"}
AGENTS = ("Mozilla/5.0 (X11; Linux x86_64; rv:128.0) Gecko/20100101 Firefox/128.0", "Mozilla/5.0 (Windows NT 10.0; Win64; x64; rv:128.0) Gecko/20100101 Firefox/128.0")
#: Tokens that an image counts beside its text, and file types of subtitles in the order in which they are looked for.
IMAGE_TOKENS, SUBTITLE_TYPES = 85, ("vtt", "srt", "ass", "lrc")


class Fatal(Exception):
    """A failure that another try does not mend."""


class Retry(Exception):
    """A failure that may pass; `after` seconds if the other side says so."""

    def __init__(self, message: str = "", after: float | None = None):
        super().__init__(message)
        self.after = after


@dataclass
class Answer:
    status: int = 200
    body: bytes = b""
    content_type: str = "text/html"
    after: float | None = None  # seconds after which to ask again, if the other side says so


class Connector(Protocol):
    def get(self, url: str) -> Answer: ...


@dataclass
class Recorded:
    """Answers by URL; others are not found. Doubles as the stub where no network is."""

    answers: dict[str, Answer] = field(default_factory=dict)

    def get(self, url: str) -> Answer:
        return self.answers.get(url, Answer(404))


def verdict(status: int) -> str:
    return "ok" if status < 400 else "retry" if status == 429 or status >= 500 else "fatal"


def tool_verdict(message: str) -> str:
    """An error's class, `retry`, or `fatal` for messages that aren't known."""
    low = message.lower()
    return next((what for part, what in TOOL_MESSAGES if part in low), "fatal")


def with_retries(call, retries: int = 3, base: float = 2.0, sleep=time.sleep):
    """call() until it succeeds, waiting base ** attempt seconds between tries."""
    for attempt in range(retries):
        try:
            return call()
        except Retry as e:
            if attempt == retries - 1:
                raise Fatal(str(e)) from e
            sleep(e.after if e.after is not None else base**attempt)
    raise Fatal("no tries")


class ToolFailure(Exception):
    """A tool ended with this message; tool_verdict() tells what it means."""


def ran(call, retries: int = 3, base: float = 2.0, sleep=time.sleep):
    """call() of a tool, tried again where its message says that the failure may pass; else a Fatal with its class."""

    def once():
        try:
            return call()
        except ToolFailure as e:
            what = tool_verdict(str(e))
            if what == "retry":
                raise Retry(str(e)) from e
            raise Fatal(str(e) if what == "fatal" else f"{what}: {e}") from e

    return with_retries(once, retries, base, sleep)


class Limiter:
    """Sliding window over requests and tokens. Share a budget among tasks by dividing it by their number."""

    def __init__(self, tokens: int = 150_000, requests: int = 100, threshold: float = 0.8, window: float = 60.0, clock=time.monotonic, sleep=time.sleep):
        self.tokens, self.requests, self.window, self.clock, self.sleep = tokens * threshold, int(requests * threshold), window, clock, sleep
        self.used: deque[list] = deque()
        self.lock = threading.Lock()

    def wait_for(self, estimate: int) -> float:
        """Seconds until a request of so many tokens fits; 0 if it does now."""
        now = self.clock()
        while self.used and self.used[0][0] <= now - self.window:
            self.used.popleft()
        total, n, wait = sum(u[1] for u in self.used), len(self.used), 0.0
        if total + estimate <= self.tokens and n + 1 <= self.requests:
            return wait
        for at, tokens in self.used:
            total, n, wait = total - tokens, n - 1, at + self.window - now + 0.1
            if total + estimate <= self.tokens and n + 1 <= self.requests:
                return wait
        return self.window

    def acquire(self, estimate: int = 0) -> list:
        while True:
            with self.lock:
                if (wait := self.wait_for(estimate)) <= 0 or not self.used:
                    entry = [self.clock(), 0]
                    self.used.append(entry)
                    return entry
            self.sleep(wait)

    @staticmethod
    def record(entry: list, tokens: int) -> None:
        entry[1] = tokens


def headers(kind: str = "html", url: str = "", rotate: bool = True) -> dict[str, str]:
    """Request headers; which agent is named depends on the URL alone, so that a task that runs again asks the same."""
    agent = AGENTS[zlib.crc32(url.encode()) % len(AGENTS)] if rotate else AGENTS[0]
    return {"User-Agent": agent, **HEADERS, **({"Accept": ACCEPTED[kind]} if kind in ACCEPTED else {})}


def decoded(answer: Answer) -> str:
    """A page's text: by the charset of its header, else of its markup, else UTF-8."""
    told = re.search(r"charset=[\"']?([\w-]+)", answer.content_type) or re.search(r"charset=[\"']?([\w-]+)", answer.body[:2048].decode("latin-1"))
    try:
        return answer.body.decode(told.group(1) if told else "utf-8", "replace")
    except LookupError:
        return answer.body.decode("utf-8", "replace")


def got(connector: Connector, url: str) -> Answer:
    """One answer, or the kind of its failure."""
    try:
        answer = connector.get(url)
    except (ConnectionError, TimeoutError) as e:
        raise Retry(str(e)) from e
    what = verdict(answer.status)
    if what == "retry":
        raise Retry(f"HTTP {answer.status}", answer.after)
    if what == "fatal":
        raise Fatal(f"HTTP {answer.status}")
    return answer


@dataclass(frozen=True)
class Http:
    """A connector that asks over HTTP with the standard library. `kind` tells what is asked for (html, pdf or image);
    `rotate` names an agent by the URL; without `verify`, certificates are not checked."""

    kind: str = "html"
    timeout: float = 30.0
    verify: bool = True
    rotate: bool = True

    def get(self, url: str) -> Answer:
        if not url.lower().startswith(("http://", "https://")):
            return Answer(400)
        context = None if self.verify else ssl._create_unverified_context()
        request = urllib.request.Request(url, headers=headers(self.kind, url, self.rotate))
        try:
            with urllib.request.urlopen(request, timeout=self.timeout, context=context) as reply:
                return Answer(reply.status, _unpacked(reply.read(), reply.headers.get("Content-Encoding")), reply.headers.get("Content-Type") or "")
        except urllib.error.HTTPError as e:
            after = e.headers.get("Retry-After") if e.headers else None
            return Answer(e.code, b"", "", float(after) if after and after.isdigit() else None)
        except (urllib.error.URLError, http.client.HTTPException, OSError) as e:
            raise ConnectionError(str(e)) from e


def _unpacked(body: bytes, encoding: str | None) -> bytes:
    """A body without its transfer's compression, which the headers allow for."""
    if encoding == "gzip":
        return gzip.decompress(body)
    return zlib.decompress(body) if encoding == "deflate" else body


def _fetch(connector: Connector, retries: int, base: float, kind: str, batches):
    for batch in batches:
        rows = []
        for doc_id, url in zip(batch["doc_id"], batch["url"], strict=True):
            try:
                a = with_retries(partial(got, connector, url), 1 if kind == "image" else retries, base, sleep=lambda s: None if isinstance(connector, Recorded) else time.sleep(s))
                picture = kind != "image" or "image" in a.content_type or "octet-stream" in a.content_type
                rows.append((doc_id, url, a.body if picture else b"", decoded(a) if kind == "html" else None, a.content_type, None, None))
            except Fatal as e:
                rows.append((doc_id, url, b"", None, None, None, None) if kind == "image" else (doc_id, url, None, None, None, "NetworkError", str(e)))
        yield pd.DataFrame(rows, columns=["doc_id", "url", "content", "html", "content_type_header", "error_type", "error_message"])


def fetched(items: DataFrame, connector: Connector, retries: int = 3, base: float = 2.0, kind: str = "html") -> DataFrame:
    """Items (doc_id, url) with content (and html, for pages), or with an error. Images are tried once, and are empty on any
    failure or where the answer is no image."""
    schema = "url string, content binary, html string, content_type_header string, error_type string, error_message string"
    return _mapped(items.select("doc_id", "url"), partial(_fetch, connector, retries, base, kind), schema)


def _mapped(items: DataFrame, each, schema: str) -> DataFrame:
    ship(items.sparkSession)
    return items.mapInPandas(each, f"doc_id {items.schema['doc_id'].dataType.simpleString()}, {schema}")


class Tool(Protocol):
    """A video tool: lines of metadata (one JSON each), subtitle files by name, an audio file."""

    def metadata(self, url: str) -> str: ...

    def subtitles(self, url: str, lang: str, is_auto: bool) -> dict[str, str]: ...

    def audio(self, url: str) -> bytes: ...


@dataclass
class RecordedTool:
    lines: dict[str, str] = field(default_factory=dict)
    files: dict[tuple[str, str, bool], dict[str, str]] = field(default_factory=dict)
    sounds: dict[str, bytes] = field(default_factory=dict)

    def _of(self, table: dict, key):
        if key not in table:
            raise Fatal("VideoUnavailableError: Video unavailable")
        return table[key]

    def metadata(self, url: str) -> str:
        return self._of(self.lines, url)

    def subtitles(self, url: str, lang: str, is_auto: bool) -> dict[str, str]:
        return self.files.get((url, lang, is_auto), {})

    def audio(self, url: str) -> bytes:
        return self._of(self.sounds, url)


def _metadata(tool: Tool, whole: bool, batches):
    for batch in batches:
        rows = []
        for doc_id, url in zip(batch["doc_id"], batch["url"], strict=True):
            try:
                text = ran(partial(tool.metadata, url))
                rows.append((doc_id, url, text if whole else text.split("\n", 1)[0], None, None))
            except (Fatal, Retry) as e:
                kind, _, message = str(e).partition(": ")
                rows.append((doc_id, url, None, kind if message else "PipelineError", message or kind))
        yield pd.DataFrame(rows, columns=["doc_id", "url", "json", "error_type", "error_message"])


def video_metadata(items: DataFrame, tool: Tool, whole: bool = False) -> DataFrame:
    """Items (doc_id, url) with json, the first line that the tool tells, or with all lines for playlists (`whole`)."""
    return _mapped(items.select("doc_id", "url"), partial(_metadata, tool, whole), "url string, json string, error_type string, error_message string")


def subtitle_file(names, lang: str) -> str | None:
    """The file to read: of the language by type, else any VTT, else any SubRip file."""
    names = sorted(names)
    wanted = [n for t in SUBTITLE_TYPES for n in names if n.endswith(f".{lang}.{t}")] + [n for t in ("vtt", "srt") for n in names if n.endswith(f".{t}")]
    return wanted[0] if wanted else None


def _subtitles(tool: Tool, batches):
    for batch in batches:
        rows = []
        for doc_id, url, lang, auto in zip(*(batch[c] for c in ("doc_id", "url", "lang", "is_auto")), strict=True):
            try:
                files = ran(partial(tool.subtitles, url, lang, bool(auto))) if lang else {}
            except (Fatal, Retry):
                files = {}
            name = subtitle_file(files, lang or "")
            rows.append((doc_id, name, files.get(name), lang, auto, None if name else "NoSubtitlesError"))
        yield pd.DataFrame(rows, columns=["doc_id", "path", "text", "lang", "is_auto", "error_type"])


def subtitle_files(tracks: DataFrame, tool: Tool) -> DataFrame:
    """Chosen tracks (doc_id, url, lang, is_auto) with the path and text of their files, or with an error."""
    return _mapped(tracks.select("doc_id", "url", "lang", "is_auto"), partial(_subtitles, tool), "path string, text string, lang string, is_auto boolean, error_type string")


class Speech(Protocol):
    """Speech recognition: (segments as (start, end, text), language). The device is its own choice."""

    def transcribe(self, audio: bytes, language: str | None) -> tuple[list[tuple[float, float, str]], str]: ...


def _speech(tool: Tool, speech: Speech, batches):
    for batch in batches:
        rows = []
        for doc_id, url, lang in zip(batch["doc_id"], batch["url"], batch["language"], strict=True):
            base = (lang or "").split("-")[0].lower()
            try:
                segments, found = speech.transcribe(ran(partial(tool.audio, url)), base if 0 < len(base) <= 3 else None)
            except (Fatal, Retry):
                continue
            said = [(a, b, t.strip()) for a, b, t in segments if t.strip()]
            rows += [(doc_id, i, float(a), float(b), t, found or base or "und") for i, (a, b, t) in enumerate(said)]
        yield pd.DataFrame(rows, columns=["doc_id", "seq", "start_seconds", "end_seconds", "text", "language"])


def transcribed(items: DataFrame, tool: Tool, speech: Speech) -> DataFrame:
    """Cues of the audio of items (doc_id, url, language); blank segments go, and what can't be heard has no cues."""
    return _mapped(items.select("doc_id", "url", "language"), partial(_speech, tool, speech), "seq bigint, start_seconds double, end_seconds double, text string, language string")


class Converter(Protocol):
    """Layout conversion of a PDF: Markdown, JSON properties, pictures by name. `pages` is as page_range tells."""

    def convert(self, content: bytes, pages: str | None) -> tuple[str, str, dict[str, bytes]]: ...


def _converted(converter: Converter, pages: str | None, least: int, batches):
    for batch in batches:
        rows = []
        for doc_id, content in zip(batch["doc_id"], batch["content"], strict=True):
            try:
                text, properties, pictures = converter.convert(bytes(content or b""), pages)
                short = len(text.strip()) < least
                rows.append((doc_id, text, properties, [{"ref": k, "image_bytes": v} for k, v in sorted(pictures.items())], "PDFExtractionError" if short else None))
            except (Fatal, Retry, ValueError):
                rows.append((doc_id, None, None, [], "PDFExtractionError"))
        yield pd.DataFrame(rows, columns=["doc_id", "text", "json", "pictures", "error_type"])


def converted_pdfs(pdfs: DataFrame, converter: Converter, pages: str | None = None, min_content_length: int = 200) -> DataFrame:
    """PDF files (doc_id, content) as Markdown text, json and pictures, or with an error."""
    schema = "text string, json string, pictures array<struct<ref:string,image_bytes:binary>>, error_type string"
    return _mapped(pdfs.select("doc_id", "content"), partial(_converted, converter, pages, min_content_length), schema)


class Model(Protocol):
    """A language model: (answer, prompt tokens, answer tokens). `image` with its media type for vision."""

    def complete(self, system: str, user: str, image: bytes | None = None, media_type: str | None = None) -> tuple[str, int, int]: ...


def estimate(text: str) -> int:
    return max(1, len(text) // 4)


def asked(model: Model, limiter: Limiter, system: str, user: str, image: bytes | None = None, media_type: str | None = None, patterns: tuple[str, ...] = ()) -> str:
    """One answer within the limits. An answer that holds one of the patterns of errors is a failure, but not for images."""
    entry = limiter.acquire(estimate(system + user) + (IMAGE_TOKENS if image is not None else 0))
    answer, prompt, told = model.complete(system, user, image, media_type)
    limiter.record(entry, prompt + told)
    if image is None and (bad := next((p for p in patterns if p.lower() in answer.lower()), None)):
        raise Fatal(f"error pattern: {bad}")
    return answer


def in_order(calls: Iterable[Callable[[], Any]], in_flight: int) -> Iterator[Any]:
    """What calls give, in their order, with at most so many of them begun and not taken."""
    with ThreadPoolExecutor(max_workers=in_flight) as pool:
        running: deque = deque()
        for call in calls:
            if len(running) >= in_flight:
                yield running.popleft().result()
            running.append(pool.submit(call))
        while running:
            yield running.popleft().result()


def _answers(model: Model, system: str, patterns: tuple[str, ...], limits: dict, keys: list[str], in_flight: int, batches):
    limiter = Limiter(**limits)

    def one(user: str) -> tuple[str | None, str | None]:
        try:
            return asked(model, limiter, system, user, patterns=patterns), None
        except (Fatal, Retry) as e:
            return None, str(e)

    for batch in batches:
        told = list(in_order((partial(one, user) for user in batch["message"]), in_flight))
        yield batch[keys].assign(answer=[a for a, _ in told], error_message=[e for _, e in told])


def answered(work: DataFrame, model: Model, system: str, patterns: tuple[str, ...] = ("rate limit", "overloaded"), limits: dict | None = None, in_flight: int = 8) -> DataFrame:
    """Work (keys, message) with the model's answers; failures are null answers.

    Equal messages are asked once, told by their digest, and their rows share the answer. A task has `in_flight` calls at a
    time at most. Limits hold in each task: divide a budget by the number of tasks that run at once, or plan the calls'
    times by budgets.shared_budget. Rows without a message are not asked and have no answer.
    """
    ship(work.sparkSession)
    rows = work.withColumn("digest_", F.sha2("message", 256))
    once = rows.where("message IS NOT NULL").groupBy("digest_").agg(F.first("message").alias("message"))
    each = partial(_answers, model, system, patterns, limits or {}, ["digest_"], in_flight)
    told = once.mapInPandas(each, "digest_ string, answer string, error_message string")
    return rows.drop("message").join(told, "digest_", "left").drop("digest_")


def _described(model: Model, system: str, user: str, limits: dict, in_flight: int, batches):
    limiter = Limiter(**limits)

    def one(image: bytes, media: str, label: str | None, alt: str | None) -> str | None:
        try:
            return asked(model, limiter, system, user.format(label=label or "", alt=alt or ""), bytes(image), media).strip() or None
        except (Fatal, Retry):
            return None

    for batch in batches:
        calls = (partial(one, *r) for r in zip(*(batch[c] for c in ("image_bytes", "media_type", "source_label", "alt_text")), strict=True))
        yield batch[["doc_id", "position_marker"]].assign(description=list(in_order(calls, in_flight)))


def described(images: DataFrame, model: Model, system: str = "Describe the image.", user: str = "Source: {label}. Text: {alt}", limits: dict | None = None, in_flight: int = 8) -> DataFrame:
    """Images (doc_id, position_marker, image_bytes, media_type, source_label, alt_text) with a description each, null where
    the model fails."""
    rows = images.select("doc_id", "position_marker", "image_bytes", "media_type", "source_label", "alt_text")
    return _mapped(rows, partial(_described, model, system, user, limits or {}, in_flight), "position_marker string, description string")
