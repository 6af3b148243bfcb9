import random
from collections import defaultdict

from wiretide.llm import substring_dedup
from wiretide.llm.queries import op2_substring_dedup
from wiretide.llm.substring_dedup import duplicate_spans, remove_spans, text_units


def brute(rows, unit, least):
    """Spans by walking documents in order of id."""
    rows = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, r[1] or ""))
    order = sorted(((r[0] is not None, r[0] or 0), k, r) for k, r in enumerate(rows))
    seen, out = {}, []
    for _, _, (doc, text) in order:
        runs = defaultdict(list)
        place = 0
        for k, (a, b, n, plain) in enumerate(text_units(text or "", unit)):
            if plain in seen:
                runs[place].append((a, b, n, seen[plain]))
            else:
                seen[plain] = doc
                place = k + 1
        for run in runs.values():
            if sum(r[2] for r in run) >= least:
                out.append((doc, run[0][0], run[-1][1], sum(r[2] for r in run), len(run), run[0][3]))
    return sorted(out)


def test_spans_equal_a_walk(spark):
    dice = random.Random(8)
    sentences = [" ".join(dice.choice(["é", "of", "The", "river", "x"]) for _ in range(dice.randint(1, 9))) + "." for _ in range(40)]
    rows = [(k, " ".join(dice.choice(sentences) for _ in range(dice.randint(0, 12))).replace(". é", ".\né")) for k in range(80)]
    rows += [(100, None), (101, ""), (102, "...\n\n!? ?")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for unit, least in (("sentence", 6), ("line", 1), ("paragraph", 1)):
        got = duplicate_spans(docs, unit=unit, min_words=least)
        got = sorted((r.doc_id, r.start, r.end, r.n_words, r.n_units, r.first_id) for r in got.collect())
        assert got == brute(rows, unit, least)


def test_passage_inside_lines_is_removed_once(spark):
    passage = "Here stands a passage of many words. It has been copied often, by many hands! Each copy is the same as the first one was."
    rows = [(1, f"A first text. {passage} It ends."), (2, f"Another one begins and {passage} And goes on."), (3, "Nothing shared here at all.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = duplicate_spans(docs, min_words=15)
    assert [(r.doc_id, r.first_id) for r in spans.collect()] == [(2, 1)]
    left = {r.doc_id: r.text for r in remove_spans(docs, spans).collect()}
    assert left[1] == rows[0][1] and left[3] == rows[2][1]
    assert "Each copy" not in left[2] and left[2].endswith("And goes on.") and left[2].startswith("Another one begins")


def test_odd_documents(odd_documents, no_documents):
    spans = duplicate_spans(odd_documents, min_words=1)
    assert {(r.doc_id, r.first_id) for r in spans.collect()} >= {(6, 5), (11, 10)}
    assert remove_spans(odd_documents, spans).count() == odd_documents.count()
    assert duplicate_spans(no_documents).collect() == []
    assert substring_dedup.MIN_SENTENCE == 4


def test_query_finds_whole_passages_that_begin_and_end_inside_sentences(spark, tmp_path):
    dice = random.Random(21)
    words = lambda n: [f"w{dice.randrange(10**6)}" for _ in range(n)]
    rows, passages = [], {}
    for k in range(25):
        middle = dice.randint(4, 12)
        ends = dice.randint(51, 100) - middle
        head = dice.randint(20, ends - 20) if ends > 40 else ends // 2
        whole = [*words(middle - 1), f"w{k}."]
        if k % 5 == 0:
            whole[0] += "."  # a short sentence at the border of units
        passage = " ".join([*words(head - 1), f"h{k}.", *whole, *words(ends - head)])
        passages[100 + k] = passage
        for doc in (k, 100 + k):
            rows.append((doc, f"{' '.join(words(9))}. {' '.join(words(3))} {passage} {' '.join(words(5))}. {' '.join(words(6))}."))
    short = "Released under the terms of that license."
    rows += [(200, f"{' '.join(words(8))}. {short} {' '.join(words(8))}."), (201, f"{' '.join(words(7))}. {short} {' '.join(words(9))}.")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = op2_substring_dedup(spark, str(tmp_path)).collect()
    texts = dict(rows)
    assert {r.doc_id: texts[r.doc_id][r.start : r.end] for r in got} == passages
    assert all(r.n_words == len(passages[r.doc_id].split()) and r.first_id == r.doc_id - 100 for r in got)
    assert len(got) == len(passages)


def test_extension_of_odd_documents(spark, odd_documents, no_documents):
    spans = duplicate_spans(odd_documents, min_words=1, extend=True)
    assert {(r.doc_id, r.first_id) for r in spans.collect()} >= {(6, 5), (11, 10)}
    assert remove_spans(odd_documents, spans).count() == odd_documents.count()
    assert duplicate_spans(no_documents, extend=True).collect() == []
    # sides that overlap in the gap are one span, its words counted once
    rows = [(1, "a b c d e f g. One two three four."), (2, "Five six seven eight. p q c d e r."), (3, "x y z. One two three four.")]
    rows += [(4, "Five six seven eight. p q a b c d e f g. One two three four.")]
    got = duplicate_spans(spark.createDataFrame(rows, "doc_id long, text string"), min_words=1, extend=True)
    assert [(r.start, r.end, r.n_words) for r in got.where("doc_id = 4").collect()] == [(0, len(rows[3][1]), 17)]
