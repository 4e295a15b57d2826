"""Contracts of op1, op3, op5, op6 and op9 against plain Python, and their operators' round trips."""

import base64
import hashlib
import random
import sys
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from loomtext.llm import arc_warc, byte_bpe, queries, repair_tokens, tiff, winnow
from tests.llm.cases import TEXTS, documents, saved

SMALL = "/root/testdata/sf0.001"


def rows_of(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def docs_dir(spark, tmp_path_factory):
    return saved(spark, tmp_path_factory.mktemp("docs"), documents(spark))


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    return saved(spark, tmp_path_factory.mktemp("empty"), documents(spark, []))


def test_empty_tables(spark, empty_dir):
    for name in ("op3_winnowing", "op5_repair_tokens", "op6_tiff_pages", "op9_byte_bpe"):
        assert queries.QUERIES[name](spark, empty_dir).collect() == []


def test_bpe_equals_tiktoken(spark, docs_dir):
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = sorted((r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows_of(queries.op9_byte_bpe(spark, docs_dir)))
    want = []
    for k, t in TEXTS:
        ids = plain.encode_ordinary(t or "")
        want.append((k or 0, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert found == sorted(want)


def test_bpe_in_two_steps(spark):
    how = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    docs = documents(spark)
    two = byte_bpe.decode(byte_bpe.encode(docs, *how), *how).collect()
    assert sorted(map(str, two)) == sorted(map(str, byte_bpe.round_trip(docs, *how).collect()))


def test_bpe_memos_roll_over(monkeypatch):
    for name in ("CHUNK_BYTES", "PIECE_BYTES", "FIT_ENTRIES"):
        monkeypatch.setattr(byte_bpe, name, 500)
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    bpe = byte_bpe.ByteBpe(ranks, public_tokenizers.PATTERN)
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in ["one two threeish fourable fivening one", "six one two", "threeish fivening, zzgqx"] * 3:
        assert np.frombuffer(bpe.encode(text), "<u4").tolist() == plain.encode_ordinary(text)


def held_bytes(*memos):
    return sum(sys.getsizeof(k) + sys.getsizeof(v) + 100 for memo in memos for k, v in memo.items())


def test_memos_are_bounded_by_bytes():
    """Texts without spaces are not kept; many short chunks roll over. No memo goes beyond 100 MB, and ids stay right."""
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    bpe, encode = byte_bpe.ByteBpe(ranks, public_tokenizers.PATTERN), repair_tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    pick = random.Random(3)
    letters = "".join(map(chr, range(0x4E00, 0x5600)))
    for i in range(10):
        dense = "".join(pick.choices(letters, k=30_000)) + "。" + base64.b64encode(pick.randbytes(100_000)).decode()
        assert np.frombuffer(bpe.encode(dense), "<u4").tolist() == plain.encode_ordinary(dense)
        encode([dense, "a " + dense])
    before = held_bytes(bpe._chunks, bpe._old_chunks, bpe._pieces, bpe._old_pieces), held_bytes(encode.memo, encode.old)
    assert before[0] < 16_000_000 and before[1] < 100_000  # short pieces within such texts alone
    for i in range(40):
        many = " ".join(f"w{i}x{j}" for j in range(25_000))
        bpe.encode(many)
        encode([many])
        assert held_bytes(bpe._chunks, bpe._old_chunks, bpe._pieces, bpe._old_pieces) < 110_000_000 and held_bytes(encode.memo, encode.old) < 110_000_000
    for text in (many, dense):
        assert np.frombuffer(bpe.encode(text), "<u4").tolist() == plain.encode_ordinary(text)
        assert np.frombuffer(encode([text])[0], "<u4").tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids


def test_new_chunks_of_known_words_are_not_encoded_again():
    """A chunk over a line's end is put together from its pre-tokens, each of which the library's model sees once."""
    encode, asked = repair_tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json")), []
    plain = encode.plain
    encode.plain = lambda texts: asked.extend(texts) or plain(texts)
    pick = random.Random(7)
    signs = ["word", "é", "7", ".", ",", "'s", "'", "\n", "\t", "\x1c", "-", "Été.", "中", "\0", "<|endoftext|>", " ", " ", "\x85"]
    texts = ["a fence walks.", "a walks.\nFence, fence's\n\n7th"] + ["".join(pick.choices(signs, k=pick.randint(0, 12))) for _ in range(3000)]
    assert encode(texts[:2]) + encode(texts[2:]) == plain(texts)
    assert not any("walks" in x or "Fence" in x for x in asked)


def test_bpe_on_random_bytes():
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    bpe = byte_bpe.ByteBpe(ranks, public_tokenizers.PATTERN)
    pick = random.Random(5)
    parts = ["a", "the", " ", "  ", "\n", "é", "中", "1", "'s", "!", "\xa0", "　", "\x85", "\x1c", "ing", "\U0001f600", "ωσ"]
    for _ in range(500):
        text = "".join(pick.choice(parts) for _ in range(pick.randrange(40)))
        assert np.frombuffer(bpe.encode(text), "<u4").tolist() == plain.encode_ordinary(text)


def test_repair_query(spark, docs_dir):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = sorted(rows_of(queries.op5_repair_tokens(spark, docs_dir)), key=lambda r: r["start"])
    want, start = [], 0
    for k, t in sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        want.append({"doc_id": k, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(np.array(ids, "<u4").tobytes())})
        start += len(ids)
    assert found == want


def test_repair_grammar():
    pick = np.random.default_rng(3)
    for n, top in ((0, 5), (1, 5), (5000, 3), (20000, 40), (3000, 2)):
        ids = pick.integers(0, top, n).astype(np.uint32)
        ends = np.unique(np.append(pick.integers(1, n, 20), n)) if n > 1 else np.array([n] * bool(n), int)
        symbols, symbol_ends, rules, lengths = repair_tokens.compress(ids, ends, top, rounds=8, pairs=20, least=4)
        assert repair_tokens.expand(symbols, rules, top) == ids.astype("<u4").tobytes()
        assert n < 100 or len(symbols) < n
        row = {"symbols": symbols.astype("<u4").tobytes(), "width": 4, "rules": rules.astype("<u4").tobytes(), "symbol_ends": symbol_ends.tolist(), "expansions": lengths.astype("<u4").tobytes(), "base": top}
        if n > 1:  # each document alone equals its slice of the whole
            whole = [bytes(x) for _, x in repair_tokens.read_documents(row)]
            assert whole == [ids[a:b].astype("<u4").tobytes() for a, b in zip([0, *ends[:-1]], ends)]
            assert [x for _, x in repair_tokens.read_documents(row, range(3, 6))] == whole[3:6]
    assert len(repair_tokens.compress(np.zeros(1000, np.uint32), np.array([1000]), 5, 6, 10, 2)[0]) < 40  # runs halve


def test_repair_goes_on_to_the_end():
    """Without a limit of rounds no pair within a document is left that is frequent."""
    from collections import Counter

    pick = np.random.default_rng(5)
    for n, top in ((20000, 3), (20000, 60), (4000, 1)):
        ids, ends = pick.integers(0, top, n).astype(np.uint32), np.array([n // 3, n // 3 + 1, n])
        symbols, symbol_ends, rules, lengths = repair_tokens.compress(ids, ends, top, pairs=7, least=5)
        assert repair_tokens.expand(symbols, rules, top) == ids.astype("<u4").tobytes()
        cuts = set((symbol_ends - 1).tolist())
        left = Counter((a, b) for i, (a, b) in enumerate(zip(symbols.tolist(), symbols[1:].tolist())) if i not in cuts)
        assert max(left.values(), default=0) < 5
        assert int(lengths.sum()) == sum(len(repair_tokens.expand(np.array([top + i]), rules, top)) // 4 for i in range(len(rules)))


def test_tiff_query(spark, docs_dir):
    found = {(r["doc_id"], r["n_bytes"]): r for r in rows_of(queries.op6_tiff_pages(spark, docs_dir))}
    for k, t in TEXTS:
        raw = (t or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = found[k, len(raw)]
        assert (r["payload_bytes"], r["payload_sha256"]) == (len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["media_sha256"] == hashlib.sha256(tiff.write_tiff([payload])).hexdigest()
        assert r["feature"] == "".join(f"{sum(b >> 4 == i for b in payload) * 65535 // len(payload):04x}" for i in range(16))
    assert sum(1 for _ in found) == len({(k, len((t or "").encode())) for k, t in TEXTS})


def test_tiff_codecs():
    pick = random.Random(2)
    for n in (0, 1, 63, 64, 5000, 40000):
        for data in (bytes(pick.choice(b"ab") for _ in range(n)), pick.randbytes(n), b"z" * n):
            assert tiff.packbits_decode(tiff.packbits_encode(data)) == data
            assert tiff.lzw_decode(tiff.lzw_encode(data)) == data
    # The format's own example of PackBits.
    assert tiff.packbits_decode(bytes.fromhex("FEAA02800 02AFDAA0380002A22F7AA".replace(" ", ""))) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")


def test_lzw_published_example():
    """The example that the PDF reference prints for the same code: 45 45 45 45 45 65 45 45 45 66."""
    assert tiff.lzw_decode(bytes.fromhex("800B6050220C0C8501")) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])


def test_tiff_feature():
    """Shares of 16 ranges of byte values, in 1/65535: three quarters below 16, a quarter from 240 on."""
    assert tiff.feature_of(b"\x0f" * 48 + b"\xf0" * 16) == "bfff" + "0000" * 14 + "3fff"


def test_malformed_tiffs_are_rows_with_errors():
    import struct

    def file(tags):
        return b"II*\0\x08\0\0\0" + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + b"\0\0\0\0" + b"\0" * 64

    plain = [(256, 4, 1, 4), (257, 4, 1, 4), (258, 3, 1, 8), (259, 3, 1, 1), (273, 4, 1, 100), (278, 4, 1, 4), (279, 4, 1, 16)]
    for change in ([(257, 4, 1, 2**32 - 16)], [(256, 2, 1, 65)], [(256, 11, 1, 0)], [(322, 4, 1, 16), (323, 4, 1, 0), (324, 4, 1, 8), (325, 4, 1, 4)], [(277, 3, 1, 0)], [(258, 3, 1, 0)], [(317, 3, 1, 3)], [(259, 3, 1, 999)], [(256, 9, 1, 2**32 - 5)]):
        own = {t[0]: t for t in [*plain, *change]}
        assert [p["error"] is None for p in tiff.read_tiff(file(sorted(own.values())))] == [False], change
    pick, pages = random.Random(4), [bytes(range(256)) * 3, b"\7" * 64]
    for compression in (tiff.RAW, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE):
        whole = tiff.write_tiff(pages, compression=compression, strip=5)
        for _ in range(400):
            broken = bytearray(whole)
            for _ in range(pick.randint(1, 12)):
                broken[pick.randrange(len(broken))] = pick.choice((0, 1, 255, pick.randrange(256)))
            for page in tiff.read_tiff(bytes(broken[: pick.randint(1, len(broken))])):
                assert page["error"] is None or "pixels" not in page
    for _ in range(300):
        for page in tiff.read_tiff(b"II*\0" + pick.randbytes(pick.randint(0, 80))):
            assert page["error"] is None or "pixels" not in page


def test_tiff_pages_of_every_kind():
    pages = [bytes(range(256)) * 5, b"\7" * 64, bytes(range(64)) * 300]
    for compression in (tiff.RAW, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE):
        for predictor in (1, 2):
            found = list(tiff.read_tiff(tiff.write_tiff(pages, compression=compression, predictor=predictor, strip=7)))
            assert [p["pixels"] for p in found] == pages and [p["page"] for p in found] == [0, 1, 2]
    assert [p["error"] is None for p in tiff.read_tiff(b"II*\0")] == [False]
    broken = bytearray(tiff.write_tiff(pages))
    broken[8:20] = b"\xff" * 12
    assert [p["error"] is None for p in tiff.read_tiff(bytes(broken))] == [False, True, True]


def test_tiff_big_endian_tiles_with_planes():
    """A hand-made big-endian file: 20 x 20 pixels of 16 bits, two planes, tiles of 16 x 16, predictor 2."""
    import struct

    image = np.arange(800, dtype=np.uint16).reshape(2, 20, 20) * 71
    out, places, sizes = bytearray(b"MM\0*\0\0\0\0"), [], []
    for plane in image:
        wide = np.zeros((32, 32), np.uint16)
        wide[:20, :20] = plane
        for y in (0, 16):
            for x in (0, 16):
                tile = np.diff(wide[y : y + 16, x : x + 16], axis=1, prepend=np.uint16(0)).astype(">u2")
                places.append(len(out))
                out += (block := zlib.compress(tile.tobytes()))
                sizes.append(len(block))
    lists = []
    for values in (places, sizes):
        lists.append(len(out))
        out += struct.pack(f">{len(values)}I", *values)
    struct.pack_into(">I", out, 4, len(out))
    short = lambda v: v << 16
    tags = [(256, 3, 1, short(20)), (257, 3, 1, short(20)), (258, 3, 1, short(16)), (259, 3, 1, short(8)), (277, 3, 1, short(2)), (284, 3, 1, short(2)), (317, 3, 1, short(2)), (322, 3, 1, short(16)), (323, 3, 1, short(16)), (324, 4, 8, lists[0]), (325, 4, 8, lists[1])]
    out += struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHII", *t) for t in tags) + b"\0\0\0\0"
    (page,) = tiff.read_tiff(bytes(out))
    assert page["error"] is None and page["pixels"] == image.transpose(1, 2, 0).astype("<u2").tobytes()


def test_tiff_rows_per_page(spark):
    media = [(1, bytearray(tiff.write_tiff([b"a" * 64, b"b" * 128]))), (2, None), (3, bytearray(b"")), (4, bytearray(b"nothing"))]
    found = sorted((r["doc_id"], r["page"], r["height"], r["error"] is None) for r in rows_of(tiff.pages(spark.createDataFrame(media, "doc_id bigint, media binary"))))
    assert found == [(1, 0, 1, True), (1, 1, 2, True), (4, 0, None, False)]


def brute_winnow(text, k=winnow.K, w=winnow.W):
    grams = [text[i : i + k] for i in range(max(1, len(text) - k + 1))] if text else []
    one = lambda g: int(winnow.gram_hashes(winnow.points_of(g), len(g))[0])
    hashes = [one(g) for g in grams]
    kept = []
    for i in range(max(1, len(hashes) - w + 1) if hashes else 0):
        window = hashes[i : i + w]
        least = min(window)
        at = i + max(j for j, h in enumerate(window) if h == least)
        if not kept or kept[-1] != (least, at):
            kept.append((least, at))
    return kept


def test_winnow_query(spark, docs_dir):
    found = rows_of(queries.op3_winnowing(spark, docs_dir))
    order = sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""), reverse=True)
    got = sorted((r["doc_id"] or 0, r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) for r in found)
    want = []
    for i, (k, t) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        prints = [brute_winnow(x) for x in (t, edited, after)] if len(t) < 5000 and len(after) < 5000 else None
        if prints:
            written = ["".join(f"{h:08x}{p:08x}" for h, p in x) for x in prints]
            sets = [{h for h, _ in x} for x in prints]
            near = [len(sets[0] & s) / len(sets[0] | s) if sets[0] | s else 1.0 for s in sets[1:]]
            want.append((k or 0, len(t), hashlib.sha256(edited.encode()).hexdigest(), written[0], written[1], *near))
        else:
            same = [r for r in got if r[0] == (k or 0) and r[2] == hashlib.sha256(edited.encode()).hexdigest()]
            assert len(same) == 1
            want.append(same[0])
    assert got == sorted(want)


def test_winnow_guarantee():
    """Any shared passage of K + W - 1 code points leaves a common gram."""
    pick = random.Random(9)
    letters = lambda n: "".join(pick.choice("abcdef ") for _ in range(n))
    for _ in range(30):
        shared = letters(winnow.K + winnow.W - 1)
        a, b = (set(winnow.winnow(winnow.points_of(letters(pick.randrange(200)) + shared + letters(pick.randrange(200))))[0].tolist()) for _ in range(2))
        assert a & b


def test_winnow_many_ranges(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    one = {r["doc_id"]: r for r in rows_of(winnow.edits(docs, 1))}
    many = {r["doc_id"]: r for r in rows_of(winnow.edits(docs, 13))}
    assert one == many and len(one) == docs.count()


def test_arc_versions():
    records = [("http://a/ b c", "1.2.3.4", "19990102030405", "text/html", b"HTTP/1.0 200 OK\r\nX: y\r\n\r\nbody\n"), ("http://b/", "0.0.0.0", "20000101000000", "text/plain", b"no http head"), ("http://c/", "0.0.0.0", "20000101000000", "text/plain", b"")]
    for version in (1, 2):
        found = list(arc_warc.read_arc(arc_warc.arc_file(records, version)))
        assert [(v, f["URL"], b, e) for v, f, b, e in found] == [(version, r[0], r[4], None) for r in records]
        made = [arc_warc.convert(*x) for x in found]
        assert [m["payload"] for m in made] == [b"body\n", b"no http head", b""]
        assert made[0]["date"] == "1999-01-02T03:04:05Z" and made[0]["record_id"] != made[1]["record_id"]
    cut = arc_warc.arc_file(records[:1], 1)[:-5]
    assert [e is None for *_, e in arc_warc.read_arc(cut)] == [False]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_warc_query(spark, tmp_path):
    rows = [(3, "http://x/", "<p>same é</p>"), (1, "http://y/", "<p>same é</p>"), (2, None, None), (5, "http://z/", ""), (8, "u", "alone\r\n\r\nWARC/1.1"), (8, "u", "alone\r\n\r\nWARC/1.1"), (9, "", "z" * 300_000)]
    path = saved(spark, tmp_path, pages(spark, rows), "pages")
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    first = {}
    for k, _, h in rows:
        first[h or ""] = min(k, first.get(h or "", k))
    want = sorted((k, len((h or "").encode()), digest(h), "response" if first[h or ""] == k else "revisit", first[h or ""] if first[h or ""] != k else -1) for k, _, h in rows)
    got = sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], -1 if r["refers_to"] is None else r["refers_to"]) for r in rows_of(queries.op1_arc_to_warc(spark, path)))
    assert got == want
    assert queries.op1_arc_to_warc(spark, saved(spark, tmp_path, pages(spark, []), "pages")).collect() == []


def written(spark, path, arcs):
    """Archives (key, ARC bytes) converted, written, read back."""
    from pyspark.sql import functions as F

    records = arc_warc.arc_to_warc(spark.createDataFrame([(k, bytearray(a)) for k, a in arcs], "page_id bigint, arc binary"))
    keys = records.select("page_id", F.sha1("payload").alias("sha"), F.length("payload").alias("size"), "record_id")
    arc_warc.write_warc(arc_warc.with_revisits(records, keys), str(path), file_records=3)
    return records, arc_warc.read_warcs(spark, str(path))


def test_odd_archives(spark, tmp_path):
    """Heads with bare line feeds, without an end, odd version lines, cut records, lines between records."""
    head = b"HTTP/1.0 200 OK\nA: b\n\n"
    one = arc_warc.arc_file([("http://a/x y", "1.2.3.4", "20010203040506", "text/html", head + b"line\r\n\r\nbody")], 1)
    odd = one.replace(b"1 0 loomtext", b"1x 0 loomtx")
    cut = arc_warc.arc_file([("http://b", "1.2.3.4", "20010203040506", "text/html", head + b"tail")], 1)[:-5]
    endless = arc_warc.arc_file([("http://c", "1.2.3.4", "20010203040506", "text/html", b"HTTP/1.0 204 No")], 2)
    noise = one + b"some noise\nmore 12 noise\n" + b"http://d 1.2.3.4 20010203040506 text/plain 2\nhi\n"
    records, back = written(spark, tmp_path / "w", [(1, one), (2, odd), (3, cut), (4, endless), (5, noise), (6, b""), (7, b"\0\xff\n\n junk"), (8, one)])
    errors = sorted((r["page_id"], r["error"].split(":")[0]) for r in records.where("error IS NOT NULL").collect())
    assert errors == [(3, "declared length runs past the end"), (5, "no record line"), (7, "no record line")]
    got = {(r["page_id"], r["uri"]): r for r in back.collect()}
    assert {k for k in got} == {(1, "http://a/x y"), (2, "http://a/x y"), (3, "http://b"), (4, "http://c"), (5, "http://a/x y"), (5, "http://d"), (8, "http://a/x y")}
    assert got[1, "http://a/x y"]["payload_bytes"] == len(b"line\r\n\r\nbody") and got[4, "http://c"]["payload_bytes"] == 0 and got[3, "http://b"]["payload_bytes"] == 0
    assert [got[k, "http://a/x y"]["record_type"] for k in (1, 2, 5, 8)] == ["response", "revisit", "revisit", "revisit"]
    assert {got[k, "http://a/x y"]["refers_to_id"] for k in (2, 5, 8)} == {got[1, "http://a/x y"]["record_id"]}


def test_fuzzed_archives():
    pick = random.Random(9)
    whole = arc_warc.arc_file([(f"http://a/{i}", "1.2.3.4", "20010203040506", "text/html", b"HTTP/1.1 200 OK\r\n\r\nbody" * 3) for i in range(4)], 2)
    for _ in range(1500):
        broken = bytearray(whole)
        for _ in range(pick.randint(1, 10)):
            broken[pick.randrange(len(broken))] = pick.choice((0, 10, 32, 255, pick.randrange(256)))
        for found in arc_warc.read_arc(bytes(broken[: pick.randint(0, len(broken))])):
            row = arc_warc.convert(*found)
            assert b"\r\n\r\n" in row["http_head"] and arc_warc.warc_record(row).startswith(b"WARC/1.1\r\n")
    for _ in range(300):
        for found in arc_warc.read_arc(pick.randbytes(pick.randint(0, 200))):
            arc_warc.convert(*found)


def test_archives_begin_with_their_own_record(spark, tmp_path):
    import glob
    import gzip

    arcs = [(i, arc_warc.arc_file([("http://a", "0.0.0.0", "20010203040506", "text/html", str(i).encode())], 1)) for i in range(20)]
    _, back = written(spark, tmp_path / "w", arcs)
    names = glob.glob(str(tmp_path / "w" / "part-*"))
    heads = [list(arc_warc.read_warc(gzip.open(n))) for n in names]
    assert len(names) > 5 and all(h[0][0]["warc-type"] == "warcinfo" and 1 < len(h) <= 3 for h in heads) and back.count() == 20


def test_revisits_refer_to_record_ids(spark):
    found = {r["page_id"]: r for r in arc_warc.page_keys(spark.createDataFrame([(1, "http://a\nb", "x"), (2, None, None), (None, "", "y"), (3, "http://c", "é")], "page_id bigint, url string, html string")).collect()}
    records = arc_warc.arc_to_warc(arc_warc.pages_to_arc(spark.createDataFrame([(1, "http://a\nb", "x"), (2, None, None), (None, "", "y"), (3, "http://c", "é")], "page_id bigint, url string, html string")))
    assert {r["page_id"]: r["record_id"] for r in records.collect()} == {k: r["record_id"] for k, r in found.items()}


def test_warc_oracle(spark):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW pages AS SELECT * FROM '{SMALL}/pages.parquet'")
    want = db.sql(queries.OP1_SQL)
    got = queries.op1_arc_to_warc(spark, SMALL)
    assert got.columns == want.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))
