import random

import numpy as np
import pytest

import corpus_pipeline
from wiretide.llm import near_dedup


def brute(rows, size, percent):
    sets = []
    for _, text in rows:
        words = (text or "").lower().split()
        sets.append({tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set())
    up = list(range(len(rows)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                up[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for k, (doc, _) in enumerate(rows):
        least[root(k)] = min(doc, least.get(root(k), doc))
    return sorted((doc, len(sets[k]), least[root(k)], least[root(k)] == doc) for k, (doc, _) in enumerate(rows))


def changed(dice, words, share):
    return [w if dice.random() > share else f"n{dice.randint(0, 10**6)}" for w in words]


def test_groups_equal_brute_force(spark, monkeypatch):
    """A hot group whose copies are near the original but not each other, chains, copies, short texts."""
    monkeypatch.setattr(near_dedup, "BLOCK", 40)
    dice = random.Random(8)
    base = [f"w{dice.randint(0, 500)}" for _ in range(120)]
    rows = [(k, " ".join(changed(dice, base, dice.choice([0.01, 0.03, 0.06, 0.09])))) for k in range(150)]
    chain = [f"c{dice.randint(0, 500)}" for _ in range(60)]
    for k in range(200, 230):
        chain = changed(dice, chain, 0.03)
        rows.append((k, " ".join(chain)))
    rows += [(300 + k, " ".join(base)) for k in range(40)]
    rows += [(400 + k, " ".join(f"u{dice.randint(0, 60)}" for _ in range(dice.randint(0, 6)))) for k in range(60)]
    rows += [(500, None), (501, ""), (502, "a b c d e f"), (503, "A  B\nc d e f"), (504, "one"), (505, "One")]
    dice.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = near_dedup.near_duplicates(docs, shingle=2).collect()
    assert sorted(map(tuple, got)) == brute(rows, 2, 80)


def test_estimate_follows_similarity():
    dice = np.random.default_rng(1)
    for similarity in (0.95, 0.8, 0.6):
        errors = []
        for _ in range(30):
            both = int(1000 * 2 * similarity / (1 + similarity))
            values = dice.integers(0, 2**63, 2000 - both, dtype=np.uint64)
            x, y = np.sort(values[:1000]), np.sort(values[1000 - both :])
            bits = np.bitwise_count(near_dedup.odd_sketch(near_dedup.minhash(x)) ^ near_dedup.odd_sketch(near_dedup.minhash(y)))
            errors.append(abs(near_dedup.estimate(int(bits.sum())) - similarity))
        assert np.mean(errors) < 0.04 and max(errors) < near_dedup.MARGIN


def test_odd_documents(odd_documents, no_documents):
    got = near_dedup.near_duplicates(odd_documents).collect()
    assert len(got) == odd_documents.count()
    by_id = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got}
    assert by_id[2] == (0, 2, True) and by_id[3] == (0, 3, True)
    assert by_id[6][1:] == (5, False) and by_id[11] == (1, 10, False)
    kept = near_dedup.keep_one(odd_documents)
    assert kept.columns == odd_documents.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 5, 7, 8, 8, 9, 10]
    assert near_dedup.near_duplicates(no_documents).collect() == []
    assert near_dedup.keep_one(no_documents).collect() == []


def test_one_row_of_a_group_stays_where_ids_are_repeated(spark, odd_documents, no_documents):
    dice = random.Random(33)
    prose = lambda: " ".join(f"w{dice.randrange(10**6)}" for _ in range(60))
    one, two, three, four = prose(), prose(), prose(), prose()
    near = one + " tail"
    rows = [
        (1, one, 1), (1, one, 2), (2, one, 3), (2, two, 4),  # 2: a copy of 1 beside a text of its own
        (3, three, 5), (3, three, 6), (3, near, 7), (4, four, 8), (5, four, 9), (None, four, 10), (None, "", 11), (None, "", 12),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, number long").repartition(5)
    got = near_dedup.keep_one(docs, single=True)
    kept = sorted(r.number for r in got.collect())
    assert got.columns == docs.columns
    assert len(kept) == 6 and set(kept) - {1, 2, 5, 6} == {4, 8, 11, 12}
    assert len(set(kept) & {1, 2}) == 1 and len(set(kept) & {5, 6}) == 1
    twice = corpus_pipeline.near_duplicates(spark, docs.where("number IN (8, 9)").union(docs.where("number IN (8, 9)")), "")
    assert [r.number for r in twice.collect()] == [8]
    assert sorted(r.doc_id or 0 for r in near_dedup.keep_one(odd_documents, single=True).collect()) == [0, 0, 1, 2, 3, 4, 5, 7, 8, 9, 10]
    assert near_dedup.keep_one(no_documents, single=True).collect() == []


def test_thresholds_that_bands_would_miss_are_refused():
    for percent in (50, 79, 101):
        with pytest.raises(ValueError, match="percent"):
            near_dedup._judged(None, 5, percent)
