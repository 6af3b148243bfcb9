import random
from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import tiktoken

from wiretide.llm import bpe, packing

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def brute_best_fit(sizes, room):
    rows, left = [], []
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        fits = [r for r in range(len(rows)) if left[r] >= sizes[k]]
        if not fits:
            rows.append([k])
            left.append(room - sizes[k])
        else:
            row = min(fits, key=lambda r: left[r])
            rows[row].append(k)
            left[row] -= sizes[k]
    return sorted(left), len(rows)


def test_best_fit_decreasing_equals_a_full_search():
    dice = random.Random(6)
    for _ in range(300):
        room = dice.randint(1, 40)
        sizes = [dice.randint(1, room) for _ in range(dice.randint(0, 60))]
        rows = packing.best_fit_decreasing(sizes, room)
        assert sorted(k for row in rows for k in row) == list(range(len(sizes)))
        left = [room - sum(sizes[k] for k in row) for row in rows]
        assert min(left, default=0) >= 0
        assert (sorted(left), len(rows)) == brute_best_fit(sizes, room)


def test_rows_give_back_every_document(odd_documents):
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    docs = odd_documents.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    for group in (4_000_000, 3_000):
        got = defaultdict(dict)
        for row in packing.pack(docs, PATH, public_tokenizers.PATTERN, length=512, group_tokens=group).collect():
            ids, places = np.frombuffer(row.ids, "<u2"), np.frombuffer(row.position_ids, "<u2")
            assert len(ids) == len(places) == 512 and row.cu_seqlens[0] == 0 and row.cu_seqlens[-1] == row.tokens
            assert (ids[row.tokens :] == 50_256).all()
            for k, (doc, start) in enumerate(zip(row.doc_ids, row.starts)):
                a, b = row.cu_seqlens[k : k + 2]
                assert (places[a:b] == np.arange(b - a)).all()
                got[doc][start] = ids[a:b].tolist()
        for row in docs.collect():
            parts = got.get(row.doc_id, {})
            whole = [i for start in sorted(parts) for i in parts[start]]
            assert whole == (encoding.encode_ordinary(row.text) + [50_256] if row.text else [])


def test_empty_table(no_documents):
    assert packing.pack(no_documents, PATH, public_tokenizers.PATTERN).collect() == []


def test_new_words_of_a_batch_share_a_tokenizer_call():
    encoder = packing.Encoder(bpe.read_ranks(PATH), public_tokenizers.PATTERN)
    calls, real = [], encoder.encoding.encode_ordinary
    encoder.encoding = SimpleNamespace(encode_ordinary=lambda text: (calls.append(text), real(text))[1])
    texts = ["the qxz river  of\n stone 12", "", "another  garden, \u3000 letter", " a "]
    assert [np.frombuffer(raw, "<u2").tolist() for raw in encoder.batch(texts)] == [real(t) for t in texts]
    assert len(calls) <= 1 + len(texts)
