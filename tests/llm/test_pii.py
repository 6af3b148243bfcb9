import random
import re

import pytest

from wiretide.llm import pii


def walked(text):
    """Base spans by the plain patterns, every match checked on its own."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        total = sum(sum(divmod(2 * d, 10)) if k % 2 else d for k, d in enumerate(reversed(digits)))
        if 14 <= len(digits) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_base_spans_equal_plain_patterns():
    draw = random.Random(7)
    found = 0
    for _ in range(30_000):
        text = "".join(draw.choice("aZ0129._%+-@@..  ()x5") for _ in range(draw.randrange(1, 60)))
        assert pii.detected(text) == walked(text), text
        found += len(walked(text))
    assert found > 1000


DISGUISED = [
    ("jоhn@example.com", "email"), ("john at example dot com", "email"), ("john (at) example [dot] co.uk", "email"),
    ("jo​hn@exa­mple.com", "email"), ("john@example(dot)com", "email"), ("JOHN AT EXAMPLE DOT COM", "email"),
    ("plus one five five five one two three four five six seven", "phone"), ("＋1 555 123 4567", "phone"),
    ("one nine two dot one six eight dot zero dot one", "ip"), ("192․168․0․1", "ip"),
    ("４１１１ 1111 1111 1111", "card"), ("4111 1111‑1111 1111", "card"),
    ("quatre un un un un un un un un un un un un un un un", "card"), ("١٩٢.١.١.١", "ip"),
]


@pytest.mark.parametrize("hidden, kind", DISGUISED)
def test_disguises_map_back_to_the_source(hidden, kind):
    for before, after in (("", ""), ("été: ", ", then on"), ("see\n", "\n")):
        text = before + hidden + after
        added = [(a, pii.KINDS[k], b) for a, k, b, base in pii.spans_of(text) if not base]
        assert (len(before), kind, len(before) + len(hidden)) in added, text


@pytest.mark.parametrize(
    "text",
    ["look at example.com the dot", "polka dot dress at home", "one two three go", "un deux trois six",
     "иван at почта", "1990–2010", "v1.2.3 and 300.1.1.1", "", "a@b", "12 34 56"],
)
def test_clean_texts_stay_clean(text):
    assert pii.spans_of(text) == []


def test_base_spans_stay_beside_longer_ones():
    text = "mail jоhn@example.com, 4111 1111 1111 1111"
    assert pii.spans_of(text) == [(5, 0, 21, False), (7, 0, 21, True), (23, 2, 42, True)]
    assert pii.masked(text, pii.spans_of(text)) == "mail [email], [card]"


@pytest.mark.parametrize("unit", ["a", "1", "+1", "a@", "1.", "one ", " at a", "+1(", "е", " dot", "(at"])
def test_long_runs_take_time_in_proportion(unit):
    pii.spans_of(unit * 60_000)


def test_scan_and_mask(spark, odd_documents, no_documents):
    rows = [(1, "a@b.com", 7), (2, None, None), (3, "", 0), (4, "at ١.1.1.1", 10), (5, "clean", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in pii.report(pii.scan(docs)).collect()}
    assert (got[1].n_email, got[1].spans, got[1].n_added) == (1, "email:0:7", 0)
    assert got[4].spans == "ip:3:10" and got[4].n_ip == 0 and got[4].n_added == 1
    assert got[2].base_sha256 == got[3].base_sha256 == got[4].base_sha256 and got[2].spans == ""
    left = {r.doc_id: r for r in pii.mask(docs).collect()}
    assert left[1].text == "[email]" and left[1].n_chars == 7 and left[2].text is None and left[5].n_chars == 9
    assert left[4].text == "at [ip]" and left[4].n_chars == 7
    assert pii.scan(odd_documents).count() == odd_documents.count()
    kept = pii.mask(odd_documents)
    assert kept.columns == odd_documents.columns and kept.count() == odd_documents.count()
    assert pii.report(pii.scan(no_documents)).collect() == [] and pii.mask(no_documents).collect() == []
