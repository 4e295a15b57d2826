"""op2 against all pairs, op10 against held-out labels and a direct reading of its model."""

import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from loomtext.llm import ngram_join, ppm, queries, shingles
from loomtext.llm._arrays import utf8_flat
from loomtext.runtime import scratch_paths
from tests.llm.cases import TEXTS, documents, saved

SMALL = "/root/testdata/sf0.001"


def shingle_set(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(rows, num=85, den=100):
    sets = [(k, shingle_set(t)) for k, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and den * len(a & b) >= num * len(a | b):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (k, _) in enumerate(sets):
        least[find(i)].append(k)
    return sorted((k, len(s), min(least[find(i)])) for i, (k, s) in enumerate(sets))


def near_copies():
    """A large group of near copies, some just above and some just below the bound, passages that many share, copies."""
    pick = random.Random(4)
    word = lambda: "".join(pick.choice("abcdefgh") for _ in range(pick.randrange(2, 7)))
    base = [word() for _ in range(120)]
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(150):
        own = list(base)
        for _ in range(pick.choice([1, 1, 2, 2, 3, 4])):
            own[pick.randrange(len(own))] = word()
        rows.append(" ".join(own))
    for i in range(60):
        rows.append(" ".join(passage + [word() for _ in range(pick.choice([3, 8, 12, 40]))]))
    for i in range(20):
        text = " ".join(word() for _ in range(pick.randrange(1, 9)))
        rows += [text, text.upper() + "\n"]
    rows += ["", " \t", "one", "one two", "one two three", "ONE\x0btwo three", "é two three four five"]
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


def test_components_equal_all_pairs(spark):
    rows = near_copies()
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id bigint, text string, key string, n int")
    for cells in (1 << 22, 1 << 8):
        got = sorted(tuple(r) for r in ngram_join.similar_components(docs, cells=cells).collect())
        assert got == brute(rows)


def test_driver_plans_no_round_that_changes_nothing(spark):
    def least(pairs):
        root = {k: k for x in pairs for k in x}
        for _ in root:
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return sorted(root.items())

    pick, frame = random.Random(5), lambda pairs: spark.createDataFrame(pairs, "a bigint, b bigint")
    stars, rows = [(9, 1), (1, 8), (7, 3)], lambda df: sorted(tuple(r) for r in df.collect())
    with scratch_paths() as made:
        assert rows(ngram_join.components(frame(stars))) == least(stars)
        assert rows(ngram_join.components(frame([]))) == []
    assert len(made) == 2  # the edges alone
    chains = [(i, i + 1) for i in range(20, 33)] + [tuple(pick.sample(range(40, 70), 2)) for _ in range(20)]
    told = ngram_join.components(frame(stars + chains))
    assert rows(told) == least(stars + chains)
    for more in ([], [(8, 9)], [(3, 8), (100, 101)], [tuple(pick.sample(range(110), 2)) for _ in range(30)]):
        assert rows(ngram_join.joined(told, frame(more))) == least(stars + chains + more)

    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(40)), "x", 1) for i in range(6)], "doc_id bigint, text string, key string, n int")
    with scratch_paths() as made:
        assert rows(ngram_join.similar_components(docs)) == [(i, 37, i) for i in range(6)]
    assert "bounded" not in {p.rsplit("/", 1)[1].partition("-")[0] for p in made}  # no pairs, so none are counted


def test_sums_of_the_sketch_are_packed():
    counts = np.zeros(1 << 16, np.uint32)
    counts[[0, 7, -1]] = 1, 300, 1 << 31
    parts = [pa.RecordBatch.from_pydict({"slice": pa.array([3], pa.int32()), "counts": pa.array([zlib.compress(np.ascontiguousarray(counts.view(np.uint8).reshape(-1, 4).T), 1)])})] * 2
    (out,) = ngram_join._summed(iter(parts))
    packed = out.column(1)[0].as_py()
    assert out.column(0).to_pylist() == [3] and len(packed) < 1 << 14  # of 2^19 bytes
    assert (np.frombuffer(zlib.decompress(packed), np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel() == 2 * counts.astype(np.uint64)).all()


def test_components_of_odd_rows(spark, tmp_path):
    rows = [(k, t) for k, t in TEXTS if k is not None]
    got = sorted(tuple(r) for r in queries.op2_ngram_jaccard(spark, saved(spark, tmp_path, documents(spark, rows))).collect())
    assert got == brute(rows)
    lone = queries.op2_ngram_jaccard(spark, saved(spark, tmp_path, documents(spark, [(None, "a b c d e"), (4, "A b c d e")])))
    assert sorted(tuple(r) for r in lone.collect() if r["doc_id"]) == [(4, 2, 4)]
    assert queries.op2_ngram_jaccard(spark, saved(spark, tmp_path, documents(spark, []))).collect() == []


def test_links_equal_all_pairs(spark, monkeypatch):
    rows = [*near_copies(), (5, "one two three"), (None, near_copies()[0][1] + " more"), (7, near_copies()[1][1] + " more"), (7, near_copies()[2][1] + " other")]
    sets = [frozenset(shingle_set(t)) for _, t in rows]
    alike = lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= 85 * len(a | b)
    want = sorted((str(k), len(x), sum(alike(x, y) for y in sets) - bool(x)) for (k, _), x in zip(rows, sets))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for size in (ngram_join.CHUNK_SETS, 16):  # one tile or many
        monkeypatch.setattr(ngram_join, "CHUNK_SETS", size)
        got = ngram_join.link_counts(docs).collect()
        assert sorted((str(r["doc_id"]), r["n_shingles"], r["n_links"]) for r in got) == want
        assert sum(n > 20 for _, _, n in want) > 20  # links within a component
    different = list(set(sets) - {frozenset()})
    pairs = ngram_join.similar_links(docs).collect()
    assert len(pairs) == sum(alike(x, y) for i, x in enumerate(different) for y in different[:i])


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 50), (50, 70), (200, 200)]
    got = dict(ngram_join.components(spark.createDataFrame(links, "a bigint, b bigint")).collect())
    assert got == {i: 1 for i in range(1, 41)} | {50: 50, 70: 50, 100: 50}


def test_bounds_are_exact():
    for a in range(1, 60):
        for b in range(a, 60):
            need = ngram_join.needed(a, b, 85, 100)
            assert need == min(i for i in range(0, a + b + 1) if 100 * i >= 85 * (a + b - i))
            if need <= a:  # then the pair meets in the prefixes
                assert a - need + 1 <= ngram_join.index_size(a, 85, 100) <= ngram_join.prefix_size(a, 85, 100)
                assert b - need + 1 <= ngram_join.prefix_size(b, 85, 100)


def test_shingle_hashes():
    import pyarrow as pa

    texts = [t for _, t in TEXTS] + ["\x0b a\x0bB  c\n", "a b", "A B c d e a b c d"]
    flat, at = shingles.shingle_sets(*utf8_flat(pa.array(texts)), 4)
    assert np.diff(at).tolist() == [len(shingle_set(t)) for t in texts]
    again, _ = shingles.shingle_sets(*utf8_flat(pa.array(texts[-1:])), 4)
    assert again.tolist() == flat[at[-2] :].tolist()


def direct_bits(texts, text, order=ppm.ORDER, least=ppm.LEAST):
    """Code length by walking from the longest context down, with exclusion, straight from the counts."""
    counts = defaultdict(lambda: defaultdict(int))
    for t in texts:
        for i in range(len(t)):
            for k in range(min(order, i) + 1):
                counts[t[i - k : i]][t[i]] += 1
    total = 0.0
    for i, s in enumerate(text):
        shut, done = set(), False
        longest = next((k for k in range(min(order, i), -1, -1) if k <= 1 or sum(counts.get(text[i - k : i], {}).values()) >= least), 0)
        for k in range(longest, -1, -1):
            table = counts.get(text[i - k : i], {})
            n = {b: c for b, c in table.items() if b not in shut} if k <= 1 or sum(table.values()) >= least else {}
            if not n:
                continue
            full = len(n) == 256 - len(shut)
            whole = sum(n.values()) + (0 if full else len(n))
            if s in n:
                total -= math.log2(n[s] / whole)
                done = True
                break
            total -= math.log2(len(n) / whole)
            shut |= set(n)
        if not done:
            total += math.log2(256 - len(shut))
    return total


def test_code_lengths_equal_direct_reading():
    pick = random.Random(1)
    texts = {"a": [("the cat sat on the mat and " * 9).encode()], "b": [("le chat est sur la table é " * 9).encode(), b"la la"]}
    model = ppm.Model(texts)
    tries = [b"the cat", "la table é".encode(), b"zzz", b"t", bytes(pick.choice(b"the calsx") for _ in range(60))]
    flat = np.frombuffer(b"".join(tries), np.uint8)
    at = np.cumsum([0, *map(len, tries)])
    got = model.code_lengths(flat, at)
    for i, text in enumerate(tries):
        for j, name in enumerate(model.languages):
            assert got[i, j] == pytest.approx(direct_bits(texts[name], text), abs=0.01 * len(text))


def test_language_query(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = queries.op10_ppm_language(spark, SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
    right = [r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in rows if r["held_out"]]
    assert sum(right) / len(right) > 0.95


def test_language_of_odd_rows(spark, tmp_path):
    rows = queries.op10_ppm_language(spark, saved(spark, tmp_path, documents(spark))).collect()
    assert len(rows) == len(TEXTS)
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows}
    assert by[2] == by[3] == by[7] == by[12] == ("und", 0.0) and by[10][0] == "fr"
    assert queries.op10_ppm_language(spark, saved(spark, tmp_path, documents(spark, []))).collect() == []
    bare = documents(spark, [(2, "some words")])
    assert [r["lang_pred"] for r in queries.op10_ppm_language(spark, saved(spark, tmp_path, bare)).collect()] == ["und"]


def test_more_labels_than_given(spark):
    df = spark.createDataFrame([(f"text of language {i}", f"l{i}") for i in range(6)], "text string, lang string")
    with pytest.raises(ValueError, match="more than 5 labels"):
        ppm.train(df, languages=5)
    assert len(ppm.train(df, languages=6).languages) == 6
