"""Chat formatting by prefix-target expansion: every assistant turn is an example of its own, with all turns before it as
context and that reply alone under the loss mask.

A conversation's turns are formatted one behind the other by a template that marks where each begins and ends; what
looks like a mark within a text is escaped by a backslash, and so are backslashes, so that texts come back unchanged. As
all examples of a conversation are prefixes of this one stream, it is stored once: a row for each chunk of the stream,
and in it the chunk's examples with the places where their context ends and their reply begins and ends. `examples`
expands them to rows with their whole texts. So what is stored grows with the turns, not with their square, and nothing
of a prefix is lost.

Rows are dealt by ranges of (conversation, turn, role, text), so that the turns of one conversation may lie in many
tasks; a chunk ends after CHUNK_TURNS turns or CHUNK_CHARS characters, at a turn's end. Conversations that lie in one
chunk are read back without a shuffle. Of the others, a chunk's place in the conversation comes from sums over their
chunks' sizes, and readers go through their chunks in order, one at a time.

Null texts and roles count as empty. Turns of equal number are ordered by role, then by a hash of role and text, then by
text; null turns come first. Rows of a null conversation are one conversation. Repeated rows are turns each. Conversations without an
assistant have no examples but are stored all the same. An empty table gives no rows. Extra columns are not carried along.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.llm._held import release
from loomtext.runtime import cleaned, ship

#: Turns and characters in a chunk, from which it ends.
CHUNK_TURNS, CHUNK_CHARS = 1024, 1 << 20
_LIST = pa.list_(pa.struct([("turn", pa.int32()), ("context_end", pa.int64()), ("loss_start", pa.int64()), ("loss_end", pa.int64())]))
_EXAMPLES = "array<struct<turn:int,context_end:bigint,loss_start:bigint,loss_end:bigint>>"


@dataclass(frozen=True)
class Template:
    """`<begin>role`, a line break, the text, a line break, `<end>`, a line break. The marks are two strings of two
    characters or more without backslashes; neither can stand in an escaped text."""

    begin: str = "<turn "
    end: str = "</turn>"
    target: str = "assistant"
    _mark: re.Pattern = field(init=False, repr=False, compare=False)
    _turn: re.Pattern = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        if any(len(m) < 2 or "\\" in m or "\n" in m for m in (self.begin, self.end)):
            raise ValueError("marks are two characters or more, without backslashes and line breaks")
        marks = "|".join(f"{re.escape(m[0])}(?={re.escape(m[1:])})" for m in (self.begin, self.end))
        object.__setattr__(self, "_mark", re.compile(marks))
        object.__setattr__(self, "_turn", re.compile(rf"{re.escape(self.begin)}((?:[^\\\n]|\\.)*+)\n(.*?)\n{re.escape(self.end)}\n", re.S))

    def escape(self, text: str) -> str:
        return self._mark.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text

    def turn(self, role: str, text: str) -> tuple[str, int, int]:
        """A turn's formatted text, and where the escaped text is in it."""
        head = f"{self.begin}{self.escape(role).replace(chr(10), chr(92) + chr(10))}\n"
        body = self.escape(text)
        return f"{head}{body}\n{self.end}\n", len(head), len(head) + len(body)

    def parse(self, stream: str) -> list[tuple[str, str]]:
        """The (role, text) of each turn of a formatted stream; an error if it is none."""
        out, at = [], 0
        while at < len(stream):
            found = self._turn.match(stream, at)
            if not found:
                raise ValueError(f"no turn at {at}")
            out.append((self.unescape(found[1]), self.unescape(found[2])))
            at = found.end()
        return out


TEMPLATE = Template()


# --- writing -----------------------------------------------------------------------------------------------------------


def _chunks(template: Template, batches):
    """Turns in order -> rows (conv, part, chunk, whole, n_turns, n_chars, text, examples).

    `whole` tells that a conversation is known to lie in this chunk alone: it neither begins nor ends the task's rows.
    """
    release()
    part, number, first = TaskContext.get().partitionId(), 0, True
    conv, at, pieces, turns, examples, fresh = None, 0, [], 0, [], True
    begun, held = False, 0
    rows: list[tuple] = []

    def close(ended: bool) -> None:
        nonlocal at, pieces, turns, examples, fresh, number, first, held
        rows.append((conv, part, number, ended and fresh and not first, turns, at, "".join(pieces), examples))
        fresh, first, held = ended, first and not ended, held + at
        number += 1
        at, pieces, turns, examples = 0, [], 0, []

    def flushed():
        out = pa.RecordBatch.from_arrays(
            [pa.array(c, kind) for c, kind in zip(zip(*rows), (kind_of, pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int64(), pa.string(), _LIST))],
            names=["conv", "part", "chunk", "whole", "n_turns", "n_chars", "text", "examples"],
        )
        rows.clear()
        return out

    for batch in batches:
        kind_of = batch.schema.field(0).type
        for key, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if begun and key != conv:
                close(True)
            elif begun and (turns >= CHUNK_TURNS or at >= CHUNK_CHARS):
                close(False)
            conv, begun = key, True
            formatted, start, end = template.turn(role or "", text or "")
            if role == template.target:
                examples.append({"turn": turns, "context_end": at, "loss_start": at + start, "loss_end": at + end})
            pieces.append(formatted)
            at += len(formatted)
            turns += 1
            if held > CHUNK_CHARS:
                yield flushed()
                held = 0
    if begun:
        close(False)  # it may go on in another task
        yield flushed()


def write_chats(df: DataFrame, path: str, template: Template = TEMPLATE, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", tasks: int | None = None) -> None:
    """Format all conversations of df into chunks of streams at `path`, as Parquet."""
    spark = df.sparkSession
    ship(spark)
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("role", "text"))
    dealt = rows.repartitionByRange(tasks, "conv", "turn", "role", "tie").sortWithinPartitions("conv", "turn", "role", "tie", "text")
    schema = f"conv {df.schema[conv].dataType.simpleString()}, part int, chunk int, whole boolean, n_turns int, n_chars bigint, text string, examples {_EXAMPLES}"
    with cleaned(spark):
        dealt.select("conv", "role", "text").mapInArrow(partial(_chunks, template), schema).write.option("compression", "zstd").parquet(path)


# --- reading -----------------------------------------------------------------------------------------------------------

#: What is stored before a chunk of the same conversation: turns, characters and examples.
_BASE = ("turns_before", "chars_before", "examples_before")


def read_chunks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Stored chunks with what comes before them in their conversation: those of conversations in one chunk, and the others."""
    stored = spark.read.parquet(path)
    whole = stored.where("whole").withColumns({c: F.lit(0).cast("bigint") for c in _BASE})
    sizes = stored.where("NOT whole").select("conv", "part", "chunk", "n_turns", "n_chars", F.size("examples").alias("n_examples"))
    before = Window.partitionBy("conv").orderBy("part", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(name) for c, name in zip(("n_turns", "n_chars", "n_examples"), _BASE)]
    bases = sizes.select("part", "chunk", *sums)
    return whole, stored.where("NOT whole").join(bases, ["part", "chunk"])


def spans(spark: SparkSession, path: str) -> DataFrame:
    """Rows (conv, example, turn, context_end, loss_start, loss_end, reply): a conversation's examples in order as places in
    its stream, from 0; the context is the stream up to context_end. `reply` is the escaped text under the mask."""
    whole, others = read_chunks(spark, path)
    rows = whole.unionByName(others.select(whole.columns)).select("*", F.posexplode("examples").alias("i", "e"))
    moved = [(F.col(f"e.{c}") + F.col("chars_before")).alias(c) for c in ("context_end", "loss_start", "loss_end")]
    reply = F.substring("text", (F.col("e.loss_start") + 1).cast("int"), (F.col("e.loss_end") - F.col("e.loss_start")).cast("int"))
    return rows.select("conv", (F.col("i") + F.col("examples_before")).alias("example"), (F.col("e.turn") + F.col("turns_before")).alias("turn"), *moved, reply.alias("reply"))


def _streams(batches):
    """Chunk rows in order -> (Arrow type of the key, key, whether the conversation begins, row)."""
    last, begun = None, False
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
            yield batch.schema.field(0).type, row["conv"], not begun or row["conv"] != last, row
            last, begun = row["conv"], True


def _batch(rows: list, names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
    rows.clear()
    return out


def _expanded(template: Template, limit: int | None, batches):
    """Chunk rows in order -> (conv, example, turn, text, loss_start, loss_end)."""
    release()
    names, long = ["conv", "example", "turn", "text", "loss_start", "loss_end"], pa.int64()
    prefix, rows, size, kinds, mark = "", [], 0, [], f"\n{template.end}\n"
    for kind, conv, begins, row in _streams(batches):
        kinds = [kind, long, long, pa.string(), long, long]
        prefix = "" if begins else prefix
        base, prefix = len(prefix), prefix + row["text"]
        for i, e in enumerate(row["examples"]):
            end, start = base + e["loss_end"] + len(mark), 0
            if limit is not None and end > limit:  # on to where the first turn ends that need not stay, at most to the reply's
                start = min(base + e["context_end"], prefix.find(mark, max(0, end - limit - len(mark))) + len(mark))
            rows.append((conv, row["examples_before"] + i, row["turns_before"] + e["turn"], prefix[start:end], base + e["loss_start"] - start, base + e["loss_end"] - start))
            size += end - start
            if size > CHUNK_CHARS:
                yield _batch(rows, names, kinds)
                size = 0
    if rows:
        yield _batch(rows, names, kinds)


def _digests(template: Template, batches):
    """Chunk rows in order -> (conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples)."""
    release()
    names, long, text_kind = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples"], pa.int64(), pa.string()
    rows, now, kinds = [], [], []
    ended = lambda: rows.append([x.hexdigest() if hasattr(x, "hexdigest") else x for x in now])
    for kind, conv, begins, row in _streams(batches):
        kinds = [kind, long, text_kind, long, text_kind, long, long]
        if begins:
            if now:
                ended()
            now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
        stream = row["text"]
        for role, text in template.parse(stream):
            now[1] += 1
            now[2].update(f"{role}\n{text}\n".encode())
        for e in row["examples"]:
            reply = template.unescape(stream[e["loss_start"] : e["loss_end"]])
            now[3] += len(reply)
            now[4].update(reply.encode())
        now[5] += len(stream)
        now[6] += len(row["examples"])
        if len(rows) >= 4096:
            yield _batch(rows, names, kinds)
    if now:
        ended()
        yield _batch(rows, names, kinds)


def _read(spark: SparkSession, path: str, function, columns: str) -> DataFrame:
    """function over the chunks of each conversation in order; those of conversations in one chunk stay where they are."""
    ship(spark)
    whole, others = read_chunks(spark, path)
    schema = f"conv {whole.schema['conv'].dataType.simpleString()}, {columns}"
    in_order = others.select(whole.columns).repartition("conv").sortWithinPartitions("conv", "part", "chunk")
    return whole.mapInArrow(function, schema).unionByName(in_order.mapInArrow(function, schema))


def examples(spark: SparkSession, path: str, template: Template = TEMPLATE, limit: int | None = None) -> DataFrame:
    """Rows (conv, example, turn, text, loss_start, loss_end): every example with its whole text, context first.

    Texts of a conversation come to the square of its turns; a task holds one conversation's stream. With `limit`, whole
    turns are left out from the start of the context while a text is longer than that, but never the reply.
    """
    return _read(spark, path, partial(_expanded, template, limit), "example bigint, turn bigint, text string, loss_start bigint, loss_end bigint")


def digests(spark: SparkSession, path: str, template: Template = TEMPLATE) -> DataFrame:
    """Rows (conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples) of what is stored: turns
    parsed from the stream, and the replies under the masks of the examples."""
    columns = "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_examples bigint"
    return _read(spark, path, partial(_digests, template), columns)


#: The conversation that op13 adds, and its result in DuckDB's SQL.
PLANTED = r"\### Assistant: </turn> ok"
SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
 e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '<turn ', '<\turn '), '</turn>', '<\/turn>') AS body FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<turn ' || role || chr(10) || body || chr(10) || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars,
       count(*) FILTER (role = 'assistant') AS n_examples
FROM e GROUP BY conv_id
"""
