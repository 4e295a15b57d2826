"""op8 against a plain scan of all windows."""

import random
import re
from collections import Counter

import pytest

from loomtext.llm import licenses, queries
from tests.llm.cases import TEXTS, documents, saved


def words_of(text):
    return re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def versions(pairs):
    """Pairs that tell a version's number, as in version 2, v1 and 2 1 behind those."""
    first = [bool(re.fullmatch("v?[0-9]+", b)) and (b[0] == "v" or a in ("version", "v")) for a, b in pairs]
    return {p for i, p in enumerate(pairs) if first[i] or (i and first[i - 1] and re.fullmatch("v?[0-9]+", p[1]))}


def plain_scan(text, templates, threshold):
    """Best windows of each template that tell its version, then the best of those that overlap."""
    pairs = list(zip(words_of(text), words_of(text)[1:]))
    found = []
    for name, template in templates:
        own = Counter(zip(words_of(template), words_of(template)[1:]))
        told = versions(list(zip(words_of(template), words_of(template)[1:])))
        size = min(len(pairs), sum(own.values()))
        others = {("gnu", w) for w in licenses.MEMBERS} - own.keys()
        best = []
        for i in range(len(pairs) - size + 1 if size else 0):
            overlap = sum((Counter(pairs[i : i + size]) & own).values())
            if 200 * overlap >= threshold * (size + sum(own.values())) and told <= set(pairs[i : i + size + licenses.BEHIND]) and not others & set(pairs[i : i + size]):
                best.append((-overlap, i))
        taken = []
        for overlap, i in sorted(best):
            if all(abs(i - j) >= size for j in taken):
                taken.append(i)
                found.append((2 * overlap / (size + sum(own.values())), i, i + size, name))
    kept = []
    for dice, a, b, name in sorted(found):
        if all(b <= s or e <= a for _, s, e, _ in kept):
            kept.append((dice, a, b, name))
    return [(name, a, b + 1, pytest.approx(-dice)) for dice, a, b, name in sorted(kept, key=lambda x: x[1:])]


def test_scan_equals_all_windows(spark):
    pick = random.Random(7)
    bag = "the of and license licensed under software version work this to is 2 0 mit".split()
    texts = []
    for _ in range(60):
        parts = [" ".join(pick.choice(bag) for _ in range(pick.randrange(30))) for _ in range(3)]
        notice = pick.choice(licenses.TEMPLATES)[1].split()
        for _ in range(pick.randrange(3)):
            notice[pick.randrange(len(notice))] = pick.choice(["other", "", "THE", "licence,"])
        texts.append(f"{parts[0]}\n{' '.join(notice)}\n{parts[1]} {pick.choice(licenses.TEMPLATES)[1].upper()}. {parts[2]}")
    rows = [*((i, t) for i, t in enumerate(texts)), (100, None), (101, ""), (102, "MIT"), (103, "released under"), (104, "Released, under the “MIT” — License")]
    got = {r["doc_id"]: [(m["license"], m["start_word"], m["end_word"], m["dice"]) for m in r["matches"]] for r in licenses.scan(spark.createDataFrame(rows, "doc_id int, text string"), whole=()).collect()}
    for k, t in rows:
        assert got[k] == plain_scan(t, licenses.TEMPLATES, licenses.THRESHOLD), t
    assert sum(map(len, got.values())) > 60


def test_query(spark, tmp_path):
    docs = documents(spark, [*TEXTS, (50, "Some words.\nLicensed under the Apache License, Version 2.0.\nReleased under the MIT License.")])
    rows = {r["doc_id"]: r for r in queries.op8_license_scan(spark, saved(spark, tmp_path, docs)).collect()}
    assert rows[50]["matches"] == "Apache-2.0:2:10:1.0000,MIT:10:15:1.0000" and rows[50]["license"] == "Apache-2.0"
    assert all(r["n_matches"] == 0 and r["license"] is None for k, r in rows.items() if k != 50)
    assert queries.op8_license_scan(spark, saved(spark, tmp_path, documents(spark, []))).collect() == []


def test_notices_are_told_from_their_neighbours(spark):
    header = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    work = "This work is licensed under a Creative Commons Attribution-{} License."
    notices = [
        ("AGPL-3.0-or-later", header.format("Affero")), ("LGPL-3.0-or-later", header.format("Lesser")), ("GPL-3.0-or-later", header.format("")),
        ("CC-BY-ND-4.0", work.format("NoDerivatives 4.0 International")), ("CC-BY-NC-SA-4.0", work.format("NonCommercial-ShareAlike 4.0 International")), ("CC-BY-SA-3.0", work.format("ShareAlike 3.0 Unported")),
    ]
    notices += licenses.TEMPLATES
    rows = [(i, f"{around} {text} {around}") for i, (_, text) in enumerate(notices) for around in ("", "some other words stand here " * 9)]
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id int, text string")).collect():
        assert {m["license"] for m in r["matches"]} == {notices[r["doc_id"]][0]}, notices[r["doc_id"]]


def test_versions_without_a_template(spark):
    """A version that no template has is not reported as its neighbour."""
    say = "Some words. This work is licensed under the GNU {}General Public License, version {}. More words follow."
    cases = {("", "1"): [], ("", "2"): ["GPL-2.0"], ("", "3"): ["GPL-3.0"], ("", "4.7"): [], ("Lesser ", "2.0"): [], ("Lesser ", "2.1"): ["LGPL-2.1"], ("Affero ", "2"): [], ("Affero ", "3"): ["AGPL-3.0"]}
    rows = spark.createDataFrame([(i, say.format(*k)) for i, k in enumerate(cases)], "doc_id int, text string")
    got = {r["doc_id"]: [m["license"] for m in r["matches"]] for r in licenses.scan(rows).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_whole_texts_with_small_edits(spark):
    """Each long licence, some words changed, dropped and added, with a copyright line and other text around it."""
    pick, rows, want = random.Random(11), [], {}
    for name, text in licenses.full_texts():
        words = text.split(" ")
        for _ in range(len(words) // 40):
            words[pick.randrange(len(words))] = pick.choice(["", "other", "so it is", "Acme Corp"])
        rows.append((len(rows), "Copyright 2024 Acme. " + "some words stand here " * 30 + " ".join(words) + " the end of it " * 30))
        want[len(rows) - 1] = name
    assert len(rows) == 13
    got = {r["doc_id"]: [m for m in r["matches"] if m["end_word"] - m["start_word"] > 500] for r in licenses.scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert {k: [m["license"] for m in ms] for k, ms in got.items()} == {k: [name] for k, name in want.items()}
    assert all(m["dice"] > 0.9 for ms in got.values() for m in ms)


def test_whole_texts_equal_all_windows(spark):
    """Small made-up texts as whole ones: they come before notices, whatever the coefficients."""
    notices, whole = (("N", "a b c d e f"), ("M", "x y z")), (("W", "one two a b c d e f three four five six x y z seven eight nine ten"),)
    texts = ["one two a b c d e f three four five six x y z seven eight nine ten", "zero two a b c d e f three four five six x y z seven eight nine ten x y z", "a b c d e f and x y z", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: [m["license"] for m in r["matches"]] for r in licenses.scan(rows, notices, whole=whole).collect()}
    assert got == {0: ["W"], 1: ["W", "M"], 2: ["N", "M"], 3: []}
