import random
import re

import pytest

from wiretide.llm import license_scan


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())


def brute(text, templates, threshold):
    """Words, places of phrases, labels and greatest containment over all blocks and templates."""
    words, places, labels, best = split(text), [], set(), 0.0
    for phrase, label in license_scan.PHRASES.items():
        own = phrase.split()
        found = [k for k in range(len(words)) if words[k : k + len(own)] == own]
        places += found
        labels |= {label} if found else set()
    base = set(labels)
    half = license_scan.BLOCK // 2
    for start in range(0, max(len(words) - half, 1), half):
        block = set(words[start : start + license_scan.BLOCK])
        for label, template in templates:
            own = set(split(template))
            share = len(own & block) / len(own)
            if len(own & block) >= license_scan.needed(len(own), threshold):
                labels.add(label)
                best = max(best, share)
    score = 1.0 if places else best
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def test_equal_to_all_pairs(spark):
    dice = random.Random(2)
    pool = [w for _, t in license_scan.TEMPLATES for w in split(t)] + ["river", "stone", "paper"]
    rows = [(k, " ".join(dice.choice(pool) for _ in range(dice.randint(0, 150)))) for k in range(80)]
    for k, (_, template) in enumerate(license_scan.TEMPLATES):
        words = template.split()
        del words[dice.randrange(len(words))]
        rows.append((100 + k, " ".join(["filler"] * dice.randint(0, 70) + words + ["Filler"] * 40)))
    rows += [(200, "Under The MIT License; apache license, VERSION 2. CC-BY-NC"), (201, None), (202, ""), (202, "mit")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    names = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    for threshold in (0.9, 0.6):
        got = sorted(map(str, license_scan.scan(docs, threshold=threshold).select(*names).collect()))
        want = [(doc, *brute(text, license_scan.TEMPLATES, threshold)) for doc, text in rows]
        assert got == sorted(str(spark.createDataFrame([], docs.schema).schema and _row(names, w)) for w in want)


def _row(names, values):
    from pyspark.sql import Row

    return Row(**dict(zip(names, values)))


def test_odd_documents(odd_documents, no_documents):
    got = license_scan.scan(odd_documents).collect()
    assert len(got) == odd_documents.count() and not any(r.labels for r in got)
    assert license_scan.scan(no_documents).collect() == []


def test_templates_longer_than_half_a_block_are_refused():
    assert len(license_scan._sets(license_scan.TEMPLATES)) == len(license_scan.TEMPLATES)
    long_text = " ".join(f"w{k}" for k in range(33))
    with pytest.raises(ValueError, match="33 words"):
        license_scan._sets([("mit", long_text)])
