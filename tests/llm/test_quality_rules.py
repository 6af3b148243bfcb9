import random
import re
from collections import Counter

import pytest

from wiretide.llm import quality_rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    covered = {k + i for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for i in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered)


def test_counts_equal_brute_force(spark, odd_documents):
    dice = random.Random(7)
    pool = ["a", "b", "é", "x|y", "<z>", "#"]
    rows = [(k, dice.choice([" ", "\n", "\t "]).join(dice.choice(pool[: dice.randint(1, 6)]) for _ in range(dice.randint(0, 60)))) for k in range(150)]
    rows += [(r.doc_id, r.text) for r in odd_documents.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.id), tuple(r)[1:]) for r in quality_rules.counts(docs).collect())
    assert got == sorted((str(doc), brute(text)) for doc, text in rows)


@pytest.fixture(scope="module")
def labelled(spark):
    dice = random.Random(1)
    rows, labels = [], []
    for k in range(600):
        bad = k % 5 == 0
        words = [dice.choice("river stone paper window garden letter".split()) + str(dice.randint(0, 99)) for _ in range(dice.randint(30, 90))]
        rows.append((k, " ".join(w + ("***" if bad and dice.random() < 0.8 else "") for w in words)))
        labels.append((k, int(not bad)))
    labels += [(1, 1), (None, 0), (3, None)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_rules_find_what_labels_say(labelled):
    docs, labels = labelled
    got = quality_rules.judge(docs, labels).collect()
    wrong = [r for r in got if r.kept == (r.doc_id % 5 == 0)]
    assert len(got) == 600 and len(wrong) <= 6


def test_nothing_runs_outside_spark_sql(labelled):
    docs, labels = labelled
    plan = quality_rules.judge(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    plan = quality_rules.counts(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_covering_on_cells():
    every = [quality_rules.Condition("n_words", above, 10.0, 0) for above in (True, False)]
    cell = lambda code, part, bad, good: quality_rules.Cell({"n_words": code}, part, bad, good)
    cells = [cell(1, 0, 50, 1), cell(0, 0, 2, 200), cell(1, 1, 25, 0), cell(0, 1, 1, 100)]
    assert quality_rules.cover(cells, every, 8, 3, 0.9, 0.002) == [[every[0]]]
    assert quality_rules.cover([], every, 8, 3, 0.9, 0.002) == []


def test_without_labels_only_the_base_rule_counts(spark, odd_documents, no_documents):
    none = spark.createDataFrame([], "doc_id long, quality int")
    for row in quality_rules.judge(odd_documents, none).collect():
        assert row.kept == (not row.base_failed)
    assert quality_rules.judge(no_documents, none).collect() == []


def sprinkled(dice, symbols):
    """Forty words of ten letters, so many of them signs."""
    letters = [dice.choice("abcdefgh") for _ in range(400)]
    for k in dice.sample(range(400), symbols):
        letters[k] = "%"
    return " ".join("".join(letters[k : k + 10]) for k in range(0, 400, 10))


def test_a_share_that_few_texts_have_gets_real_thresholds(spark):
    """Most texts hold no sign, good ones up to 4 %, bad ones 6 % or more: only a threshold between will do."""
    dice = random.Random(12)
    rows, labels, shares = [], [], []
    for k in range(500):
        bad = k % 4 == 0
        symbols = dice.randint(24, 80) if bad else dice.choice([0, 0, 0, 0, dice.randint(1, 16)])
        rows.append((k, sprinkled(dice, symbols)))
        labels.append((k, int(not bad)))
        shares.append((symbols / 400, bad))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    quality = spark.createDataFrame(labels, "doc_id long, quality int")
    rules = quality_rules.learn(quality_rules.counts(docs), quality)
    assert [(c.feature, c.above) for rule in rules for c in rule] == [("symbol_share", True)]
    # exhaustively: the best of all single thresholds
    wrong = lambda t: sum((share > t) != bad for share, bad in shares)
    assert wrong(rules[0][0].threshold) == min(wrong(t) for t, _ in shares) == 0
    kept = {r.doc_id: r.kept for r in quality_rules.judge(docs, quality).collect()}
    assert all(kept[k] == bool(good) for k, good in labels)
