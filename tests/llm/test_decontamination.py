import hashlib
import random
import re

import pytest

from wiretide.llm import decontamination
from wiretide.llm.decontamination import Automaton, remove_words


def brute(items, words, window):
    hit, found = set(), set()
    for item, own in items:
        size = min(window, len(own))
        for start in range(len(own) - size + 1 if own else 0):
            for at in range(len(words) - size + 1):
                if words[at : at + size] == own[start : start + size]:
                    hit.update(range(at, at + size))
                    found.add(item)
    return hit, found


def test_automaton_equals_brute_force():
    dice = random.Random(3)
    for _ in range(800):
        signs = [b"a", b"b", b"c"][: dice.randint(1, 3)]
        window = dice.randint(2, 4)
        items = [(str(i), [dice.choice(signs) for _ in range(dice.randint(1, 9))]) for i in range(dice.randint(0, 4))]
        words = [dice.choice([*signs, b"z"]) for _ in range(dice.randint(0, 14))]
        spans, found = Automaton(items, window).scan(words)
        assert ({k for a, b in spans for k in range(a, b)}, found) == brute(items, words, window)


@pytest.fixture()
def tables(spark):
    dice = random.Random(9)
    vocabulary = ["alpha", "beta", "gamma", "delta"]
    words = lambda n: " ".join(dice.choice(vocabulary) for _ in range(n))
    items = [(k, words(dice.randint(1, 16))) for k in range(12)] + [(3, "Short one"), (None, words(12)), (90, None), (91, "--")]
    docs = [(k, words(dice.randint(0, 60)).replace("alpha", "ALPHA,")) for k in range(60)]
    docs += [(100, None), (101, ""), (102, f"start {items[0][1]} short ONE end"), (102, "same id")]
    return (
        spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, items string"),
        spark.createDataFrame(items, "item_id long, text string"),
        docs,
        items,
    )


@pytest.mark.parametrize("block_words", [1_000_000, 20])
def test_report_equals_brute_force(tables, block_words):
    docs, items, doc_rows, item_rows = tables
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    own = [(str(i), split(t)) for i, t in item_rows if i is not None and t]
    want = []
    for doc, text in doc_rows:
        words = split(text)
        hit, found = brute(own, words, 10)
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        want.append((doc, len(words), len(hit), len(found), digest, bool(hit)))
    got = decontamination.report(decontamination.matches(docs, items, block_words=block_words)).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_cut_removes_hit_words_only(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame(
        [(1, f"Before, {item.upper()}! After it come more words than there were in the passage itself, so it stays.", 0),
         (2, item, 0), (3, "clean", 5), (4, None, None)],
        "doc_id long, text string, n_chars long",
    )
    left = {r.doc_id: (r.text, r.n_chars) for r in decontamination.cut(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    text = "Before, ! After it come more words than there were in the passage itself, so it stays."
    assert left == {1: (text, len(text)), 3: ("clean", 5), 4: (None, None)}


def test_remove_words():
    assert remove_words("Aé b-c d", [{"first": 1, "past": 3}]) == "Aé  d"


def test_odd_documents_and_empty_tables(spark, odd_documents, no_documents):
    items = spark.createDataFrame([(1, "the river"), (2, None)], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontamination.report(decontamination.matches(odd_documents, items)).collect()
    assert len(got) == odd_documents.count() and sum(r.n_hit for r in got if r.doc_id == 8) == 12
    assert not any(r.contaminated for r in decontamination.report(decontamination.matches(odd_documents, none)).collect())
    assert decontamination.cut(no_documents, items).collect() == []
    assert decontamination.cut(odd_documents, none).count() == odd_documents.count()
    assert decontamination.cut(odd_documents, items).columns == odd_documents.columns
