import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest

from wiretide.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def sha(data):
    return hashlib.sha256(data).hexdigest()


def expected(rows, family=None):
    """Every node by its whole sequence of turns."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = sha(f"{len(role.encode())}:{role}{text}".encode())
            own[conv].append(((turn is not None, turn or 0, tie), (role, text)))
    said = {c: [t for _, t in sorted(turns)] for c, turns in own.items()}
    whole = said
    if family:
        whole = {}
        for c, turns in said.items():
            h = zlib.crc32(str(c).encode()) % 9
            whole[c] = said.get(c - int(math.fmod(c, family)), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        bytes_ = len(path[-1][1].encode()) if path else 0
        leaves[path] = sum(leaves[k] for k in kids[path]) or 1
        saved[path] = (len(members[path]) - 1) * bytes_ + sum(saved[k] for k in kids[path])
    out = []
    for path, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(whole[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out.append(
            (min(convs), len(path), parent, len(convs), len(kids[path]), leaves[path], saved[path], sha(ends.encode()))
        )
    return Counter(out)


def found(rows):
    return Counter(tuple(r) for r in prefix_trie.trie(rows).collect())


def some(convs, turns, width):
    """Conversations that share starts in a fixed pattern."""
    return [(c, t, "user" if t % 2 else None, f"é{c * 7919 % width ** (1 + t // 3)}") for c in range(convs) for t in range(turns)]


@pytest.mark.parametrize("band, chunk, ends", [(8, 1024, 512), (2, 3, 2), (3, 2, 1)])
def test_rebuilt_equals_whole_sequences(spark, monkeypatch, band, chunk, ends):
    for name, value in (("BAND", band), ("CHUNK", chunk), ("ENDS", ends), ("SALTS", 2)):
        monkeypatch.setattr(prefix_trie, name, value)
    rows = some(23, 7, 3) + [(100, t, "user", "same") for t in range(70)] + [(101, 0, "user", "x"), (-3, 1, None, None)]
    table = spark.createDataFrame(rows, SCHEMA)
    assert found(prefix_trie.rebuilt(prefix_trie.turns_of(table))) == expected(rows, 5)


def test_unchanged_conversations(spark):
    rows = some(40, 5, 2) + [(200 + c, t, "user", "copy") for c in range(30) for t in range(20)]
    table = spark.createDataFrame(rows, SCHEMA)
    assert found(prefix_trie.as_they_are(prefix_trie.turns_of(table))) == expected(rows)


def test_odd_conversations(spark):
    rows = [
        (1, None, None, None), (1, 0, "", ""), (1, 0, "user", "b"), (1, 0, "user", "a"), (2, None, "", None), (2, 5, None, ""),
        (None, 0, "user", "lost"), (3, 1, "user", "x" * 50_000), (3, 1, "user", "x" * 50_000), (-7, 0, "user", "é"),
        (2**63 - 1, 0, "a", "bc"), (-(2**63), 0, "ab", "c"), (5, None, None, None), (5, None, None, None),
    ]
    table = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA + ", depth long, hash1 long, up int")
    turns = prefix_trie.turns_of(table)
    assert found(prefix_trie.as_they_are(turns)) == expected(rows)
    none = prefix_trie.turns_of(table.limit(0))
    assert not found(prefix_trie.as_they_are(none)) and not found(prefix_trie.rebuilt(none))
