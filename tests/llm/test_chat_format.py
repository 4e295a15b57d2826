"""op13 against its SQL and a plain loop, escapes that come back, and examples with their whole contexts."""

import hashlib
from collections import defaultdict

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomtext.llm import chat_format as cf
from loomtext.llm import queries
from tests.llm.cases import saved

SCHEMA = "conv_id bigint, turn bigint, role string, text string, part int, whole string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(rows):
    """Rows (conv, turn, role, text), no two of equal number in a conversation -> the query's rows."""
    chats = defaultdict(list)
    for c, t, r, x in [*rows, (-7, 0, "user", cf.PLANTED), (-7, 1, "assistant", cf.PLANTED)]:
        chats[c].append((t, r or "", x or ""))
    out = []
    for c, turns in chats.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        size = sum(len(cf.TEMPLATE.turn(r, x)[0]) for _, r, x in turns)
        out.append((c, len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss), size, sum(r == "assistant" for _, r, _ in turns)))
    return sorted(map(repr, out))


def run(spark, path, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    return sorted(repr(tuple(r)) for r in queries.op13_chat_prefixes(spark, saved(spark, path, df, "conversations")).collect())


def test_oracle(spark):
    db = duckdb.connect()
    db.sql("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.01/conversations.parquet'")
    want = db.sql(queries.ORACLES["op13_chat_prefixes"])
    got = queries.op13_chat_prefixes(spark, "/root/testdata/sf0.01")
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


PIECES = ["\\", "<turn ", "</turn>", "<", "turn>", "/", "\n", "assistant", "é", "\U0001f600", " ", "<\\turn ", "ok"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from(PIECES), max_size=4).map("".join), st.lists(st.sampled_from(PIECES), max_size=8).map("".join)), max_size=5))
def test_template_comes_back(turns):
    for template in (cf.TEMPLATE, cf.Template("### ", "###"), cf.Template("aaa", "aa")):
        formatted = [template.turn(r, x) for r, x in turns]
        assert template.parse("".join(f for f, _, _ in formatted)) == turns
        for (f, a, b), (_, x) in zip(formatted, turns):
            assert template.unescape(f[a:b]) == x and template.end not in f[a:b] and template.begin not in f[a:b]


def test_odd_rows(spark, tmp_path, monkeypatch):
    rows = [
        (1, 0, "system", "s"), (1, 1, "user", None), (1, 2, "assistant", "a</turn>\n"), (1, 3, "assistant", None), (1, 4, "user", "tail"),
        (2, 0, "assistant", "x" * 3_000_000), (2, 1, None, "no role"), (2, 2, "assistant", "\\"), (3, 0, "user", ""), (4, None, "user", "null turn"), (4, 1, "assistant", "b"),
        (None, 1, "assistant", "null conversation"), (None, 2, "a\nb\\", "role of two lines"), (5, 7, "Assistant", "not it"), (6, -3, "assistant", "<turn user\n\\</turn>"), (-7, 5, "user", "more"),
    ]
    key = lambda r: (r[0], -(1 << 60) if r[1] is None else r[1], *r[2:])
    want = plain([key(r) for r in rows])
    assert run(spark, tmp_path / "a", rows) == want
    assert run(spark, tmp_path / "b", []) == plain([])
    again = [(9, 1, "assistant", "same"), (9, 1, "assistant", "same"), (9, 1, "user", "u")]
    got = run(spark, tmp_path / "c", again)
    assert repr((9, 3, sha("assistant\nsame\nassistant\nsame\nuser\nu\n"), 8, sha("samesame"), sum(len(cf.TEMPLATE.turn(r, x)[0]) for _, _, r, x in again), 2)) in got


def test_one_conversation_in_many_tasks(spark, tmp_path):
    """A third of the rows are one conversation of 5,000 turns: it is dealt over tasks and chunks, and comes back whole."""
    rows = [(77, i, ("user", "assistant")[i % 2], f"t{i} </turn>") for i in range(5000)]
    rows += [(c, i, ("user", "assistant")[i % 2], f"c{c} {i}") for c in range(2500) for i in range(4) if c != 77]
    assert run(spark, tmp_path / "a", rows) == plain(rows)
    path = str(tmp_path / "w")
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    cf.write_chats(df, path, tasks=6)
    hot = spark.read.parquet(path).where("conv = 77").collect()
    assert len({r["part"] for r in hot}) > 1 and max(r["n_turns"] for r in hot) <= cf.CHUNK_TURNS
    found = {(r["conv"], r["example"]): r for r in cf.spans(spark, path).collect()}
    assert len(found) == sum(r == "assistant" for _, _, r, _ in rows)
    at, stream = 0, {}
    for i in range(5000):
        stream[i] = at
        at += len(cf.TEMPLATE.turn(*rows[i][2:])[0])
    for e in range(2500):
        r = found[77, e]
        assert r["turn"] == 2 * e + 1 and r["context_end"] == stream[2 * e + 1] and cf.TEMPLATE.unescape(r["reply"]) == f"t{2 * e + 1} </turn>"
        assert r["loss_end"] - r["loss_start"] == len(r["reply"]) and r["loss_start"] > r["context_end"]


def test_examples_have_all_turns_before_them(spark, tmp_path):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()]
    rows += [(900, i, ("user", "assistant")[i % 2], f"{i} " * (i % 7)) for i in range(2600)]
    df, path = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), str(tmp_path / "w")
    cf.write_chats(df, path)
    want = {}
    for c in {r[0] for r in rows}:
        turns, n = sorted(r[1:] for r in rows if r[0] == c), 0
        for i, (_, role, _) in enumerate(turns):
            if role == "assistant":
                want[c, n] = [(r, x) for _, r, x in turns[: i + 1]]
                n += 1
    got = {(r["conv"], r["example"]): r for r in cf.examples(spark, path).collect()}
    assert got.keys() == want.keys()
    for key, r in got.items():
        assert cf.TEMPLATE.parse(r["text"]) == want[key]
        assert cf.TEMPLATE.unescape(r["text"][r["loss_start"] : r["loss_end"]]) == want[key][-1][1]
    for r in cf.examples(spark, path, limit=300).collect():
        turns = cf.TEMPLATE.parse(r["text"])
        whole = want[r["conv"], r["example"]]
        assert turns == whole[len(whole) - len(turns) :] and (len(r["text"]) <= 300 or len(turns) == 1)
        if len(turns) < len(whole):  # one more would not have fitted
            assert len(r["text"]) + len(cf.TEMPLATE.turn(*whole[-len(turns) - 1])[0]) > 300


def test_marks_that_cannot_be_escaped():
    for marks in (("<", "</turn>"), ("<turn ", "\\e"), ("a\nb", "cd")):
        with pytest.raises(ValueError):
            cf.Template(*marks)
