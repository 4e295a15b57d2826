"""Each stage of the pipeline on its own input, and the whole of it."""

import hashlib
import random
import re
from pathlib import Path
from collections import Counter

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from loomtext.llm import byte_bpe
from loomtext.runtime import scratch_root
from tests.llm.cases import TEXTS, documents, saved

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen, before = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = (before.collect(), stage(spark, before, SF))
        before = seen[name][1]
        if name != "tokens":
            assert before.columns == docs.columns

    kept, out = seen["language"]
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(r["doc_id"] for r in kept if re.search(r"[^\W\d_]", r["text"] or ""))

    kept, out = seen["near_duplicates"]
    sets = [(r["doc_id"], shingles(r["text"])) for r in kept]
    root = {k: k for k, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    assert sorted(r["doc_id"] for r in out.collect()) == sorted({find(k) for k, _ in sets})

    kept, out = seen["personal_data"]
    now = {r["doc_id"]: r for r in out.collect()}
    assert len(now) == len(kept)
    for r in kept:
        text = now[r["doc_id"]]["text"]
        assert not re.search(r"[A-Za-z0-9]@[a-z0-9]+\.", text) and now[r["doc_id"]]["n_chars"] == len(text)
        assert text == r["text"] or "<" in text

    kept, out = seen["mixing"]
    mixed = Counter(r["doc_id"] for r in out.collect())
    assert set(mixed) == {r["doc_id"] for r in kept}

    kept, out = seen["tokens"]
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((r["doc_id"], hashlib.sha256(np.array(plain.encode_ordinary(r["text"]), "<u4").tobytes()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()) for r in kept)
    assert sorted((r["doc_id"], r["ids_sha256"], r["decoded_sha256"]) for r in out.collect()) == want


def test_run_on_odd_rows(spark, tmp_path):
    tables = lambda: {p.name for p in (Path(scratch_root(spark).removeprefix("file:")) / "loomtext").glob("*")}
    before = tables()
    rows = corpus_pipeline.run(spark, saved(spark, tmp_path, documents(spark))).collect()
    assert [name.partition("-")[0] for name in tables() - before] == ["mixing"]  # what the last stage reads
    # Texts without a letter go, the copies of document 1 with it, and the row without key stays.
    assert {r["doc_id"] for r in rows} == {k for k, t in TEXTS if k not in (2, 3, 6, 7, 12)}
    assert corpus_pipeline.run(spark, saved(spark, tmp_path, documents(spark, []))).collect() == []


def test_language_rejects_what_was_not_learned(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    pick = random.Random(3)
    noise = [" ".join("".join(pick.choice("bcdfghjklmnpqrstvwxz") for _ in range(7)) for _ in range(40)), "это совсем другой язык, которого никто не учил " * 5, "x7Qk2ZpV9wLr4TbN8mHs6YdF3gJc" * 9]
    clean = docs.where("lang = 'fr' AND n_chars > 500").orderBy("doc_id").first()
    rows = [(10**6 + i, t, None, "s", len(t)) for i, t in enumerate(noise)]
    # Rows of one key, or of none, are told by their own text.
    rows += [(10**7, clean["text"], None, "s", 1), (10**7, "!!", None, "s", 2), (None, clean["text"], "en", "s", 1), (None, "...", None, "s", 3)]
    out = corpus_pipeline.language(spark, docs.unionByName(spark.createDataFrame(rows, docs.schema)), SF).collect()
    more = sorted((str(r["doc_id"]), r["text"], r["lang"]) for r in out if r["source"] == "s")
    assert more == sorted((str(k), clean["text"], "fr") for k in (10**7, None))
    assert sorted(r["doc_id"] for r in out if r["source"] != "s") == sorted(r["doc_id"] for r in docs.collect() if re.search(r"[^\W\d_]", r["text"] or ""))


def test_one_row_of_each_group(spark):
    text, near = " ".join(f"word{i}" for i in range(90)), " ".join(f"word{i}" for i in range(91))
    lone = " ".join(f"other{i}" for i in range(30))
    rows = [(1, text, "en", "a", 5), (1, text, "en", "b", 5), (1, lone, "en", "a", 5), (2, near, "en", "a", 5), (None, text, "en", "a", 5), (None, near, "en", "a", 5)]
    rows += [(None, "only rows without key hold this text", "en", "a", 5)] * 2 + [(9, " ", "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    assert Counter(map(tuple, out)) == Counter([rows[0], rows[2], rows[6], rows[8]])
