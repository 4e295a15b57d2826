"""Pre-tokens cut in NumPy against the library's and the pattern's own, and the memory of memos of them."""

import random
import sys

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from tokenizers import Tokenizer

from loomtext.llm import byte_bpe, repair_tokens
from loomtext.llm.pretokens import PATTERN, Cutter

SIGNS = ["a", "the", "s", "t", "re", "ll", "ve", "m", "d", "'", "'s", "'ll", "'r", "'l", " ", " ", "  ", "\n", "\t", "é", "'é", "中", "1", "²", "\xa0", "　", "\x85", "\x1c", "​", "!", "?!", "\U0001f600", "ωσ", "ª", "\0", "́"]


def test_cut_is_the_patterns():
    assert public_tokenizers.PATTERN == PATTERN
    cut, matches = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).pre_tokenizer.pre_tokenize_str, regex.compile(PATTERN).findall
    ways = [(Cutter(lambda s: len(cut(s))), lambda t: [t[a:b] for _, (a, b) in cut(t)]), (Cutter(lambda s: len(matches(s))), matches)]
    pick = random.Random(1)
    for _ in range(1500):
        texts = ["".join(pick.choices(SIGNS, k=pick.randint(0, 14))) for _ in range(pick.randint(0, 5))]
        raw = [t.encode() for t in texts]
        for cutter, want in ways:
            pieces, which, at = cutter.distinct(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
            assert [[pieces[i].decode() for i in which[a:b]] for a, b in zip(at[:-1], at[1:])] == [want(t) for t in texts]


def test_memos_of_the_tokens_stage_are_small():
    """Two workers beside an executor's JVM: what each remembers stays below 55 MB, whatever the texts."""
    bpe = byte_bpe.ByteBpe(byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    most = 0
    for i in range(16):
        bpe.encode(" ".join(f"w{chr(97 + i)}{chr(97 + j % 26)}{chr(97 + j // 26 % 26)}{chr(97 + j // 676)}x" for j in range(17_000)))
        most = max(most, sum(sys.getsizeof(k) + sys.getsizeof(v) + 100 for memo in (bpe._chunks, bpe._old_chunks, bpe._pieces, bpe._old_pieces) for k, v in memo.items()))
    assert 25_000_000 < most < 55_000_000 and byte_bpe.FIT_ENTRIES * 120 < 20_000_000


def test_only_texts_with_added_tokens_are_encoded_whole():
    """Texts with runs of white space or signs beyond Latin are cut as any other; an added token's name may touch others."""
    encode, asked = repair_tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json")), []
    plain = encode.plain
    encode.plain = lambda texts: asked.extend(texts) or plain(texts)
    texts = [" two  spaces\n\n and 中文 — it's", "", None, "ends <|endoftext|>", "<|endoftext|", ">", "a<|endoftext|>b <|endoftext|>", "word,\nWord  \t x"] * 2
    got = encode(texts) + encode(pa.array(texts[3:], pa.string()))
    want = plain([t or "" for t in texts])
    assert got == want + want[3:]
    assert {x for x in asked if "<|endoftext|>" not in x} <= {"<|endoftext|", ">"}
