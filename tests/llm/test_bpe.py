import random
import subprocess
import sys

import public_tokenizers
import pytest
import tiktoken

from wiretide.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
REFERENCE = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def expected(text):
    return REFERENCE.encode_ordinary(text or "")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(RANKS, public_tokenizers.PATTERN, keep_chunks=50, long_piece=40)


def test_equal_to_the_reference_on_random_texts(codec):
    dice = random.Random(4)
    signs = " \n\t\x0b\x1c\x85   ab'stłé9٣#$日本üxq"
    texts = ["".join(dice.choice(signs) for _ in range(dice.randint(0, 60))) for _ in range(1500)]
    texts += ["a" * 3000, "abc " * 50, " " * 300 + "b", "'s 're  x\n\n y ", "xyz" * 900, "<|endoftext|>", None, ""]
    for start in range(0, len(texts), 200):
        part = texts[start : start + 200]
        for text, (ids, raw) in zip(part, codec.batch(part)):
            assert ids == ",".join(map(str, expected(text))).encode()
            assert raw == (text or "").encode()


def test_heap_and_recursion_agree(codec):
    pieces = ["understanding", "Donaudampfschiff", "aaaaaaaaaaaaa", "ñandúes", "qxqxqxqxqx"]
    coded = codec.encode_pieces(pieces)
    for piece in pieces:
        ids = [int(coded[piece][i : i + 4], 16) for i in range(0, len(coded[piece]), 4)]
        assert ids == expected(piece)
        if piece.encode() not in RANKS:
            assert ids == bpe.contract(piece.encode(), RANKS)


def test_encode_and_decode_frames(spark, odd_documents):
    coded = bpe.encode(odd_documents, PATH, public_tokenizers.PATTERN, out=("ids", "decoded", "n_tokens"))
    texts = sorted((r.doc_id or 0, r.text or "") for r in odd_documents.collect())
    got = sorted((r.doc_id or 0, bytes(r.decoded).decode()) for r in coded.collect())
    assert got == texts
    for row in coded.collect():
        assert row.ids == expected(bytes(row.decoded).decode()) and row.n_tokens == len(row.ids)
    again = bpe.decode(coded.select("doc_id", "ids"), PATH)
    assert sorted((r.doc_id or 0, bytes(r.decoded).decode()) for r in again.collect()) == texts


def test_empty_table(no_documents):
    assert bpe.encode(no_documents, PATH, public_tokenizers.PATTERN).collect() == []


def test_portions_hold_all_texts_and_collection_is_paused_while_learning(monkeypatch):
    monkeypatch.setattr(bpe, "PORTION_CHARS", 10)
    texts = ["abcdefgh", None, "xy z", "", "a" * 40, "end"]
    assert list(bpe.portions(texts)) == [["abcdefgh", None, "xy z"], ["", "a" * 40], ["end"]]
    with bpe.Codec(RANKS, public_tokenizers.PATTERN) as codec:
        seen, learn = [], codec.learn
        codec.learn = lambda cut: (seen.append(bpe.gc.isenabled()), learn(cut))
        got = [raw for _, raw in codec.batch(texts)]
    assert got == [(t or "").encode() for t in texts]
    assert seen == [False] * 3 and bpe.gc.isenabled()


def test_memory_of_a_task_stays_small():
    script = """
import random, resource, sys
import public_tokenizers
from wiretide.llm import bpe
ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
dice = random.Random(7)
texts = ["".join(dice.choice("abcdefghio    ,.") for _ in range(2_000)) for _ in range(4_000)]
with bpe.Codec(ranks, public_tokenizers.PATTERN) as codec:
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for (ids, raw), text in zip(codec.batch(texts), texts):
        assert raw.decode() == text
    print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) < 130


def test_many_long_pieces_fit_the_memory_of_a_call():
    dice = random.Random(8)
    pieces = ["".join(dice.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(120)) for _ in range(9_000)]
    with bpe.Codec(RANKS, public_tokenizers.PATTERN) as codec:
        coded = codec.encode_pieces(pieces)
    for piece in pieces[::900]:
        assert [int(coded[piece][i : i + 4], 16) for i in range(0, len(coded[piece]), 4)] == bpe.contract(piece.encode(), RANKS)
