import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from wiretide.llm import merkle_manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, changed=None):
    values = {**row, **(changed or {})}
    texts = [None if values[f] is None else str(values[f]) for f in merkle_manifest.FIELDS]
    return digest(*("-" if t is None else f"{len(t.encode())}:{t}" for t in texts))


def walk(leaves, fan):
    """The root, and per leaf the (before, after) of each level, node by node."""
    paths, spots, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        runs = [nodes[k : k + fan] for k in range(0, len(nodes), fan)]
        for path, at in zip(paths, spots):
            run, place = runs[at // fan], at % fan
            path.append(("".join(run[:place]), "".join(run[place + 1 :])))
        spots = [at // fan for at in spots]
        nodes = [digest(*run) for run in runs]
    return nodes[0], paths


def expected(rows, fan=2):
    groups = defaultdict(list)
    for row in rows:
        groups[row["lang"]].append((row["doc_id"] is not None, row["doc_id"] or 0, leaf(row), row))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: (sorted(groups[g], key=lambda x: x[:3]), *walk([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], fan)) for g in langs}
    root, above = walk([trees[g][1] for g in langs], fan)
    out = []
    for g, upper in zip(langs, above):
        found, subroot, paths = trees[g]
        for (_, _, own, row), path in zip(found, paths):
            whole = path + upper
            start = own
            if row["doc_id"] is not None and row["n_chars"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0:
                start = leaf(row, {"n_chars": row["n_chars"] + 1})
            for before, after in whole:
                start = digest(before, start, after)
            proof = digest(*(a + b for a, b in whole))
            out.append((row["doc_id"], own, subroot, root, proof, start, start == root))
    return out


def audited(docs, **options):
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    return [tuple(r) for r in merkle_manifest.audit(docs, tampered, {"n_chars": more}, **options).collect()]


@pytest.mark.parametrize("fan, levels", [(2, 10), (2, 2), (3, 2), (5, 1)])
def test_equals_a_walk_over_all_nodes(spark, fan, levels):
    sizes = {"en": 41, None: 1, "de": 2, "fr": 9, "é": 16, "z": 1, "": 3}
    rows, k = [], 0
    for lang, size in sizes.items():
        for _ in range(size):
            k = (k * 37 + 11) % 1009
            rows.append({"doc_id": k, "source": None if k % 5 == 0 else "s", "lang": lang, "n_chars": None if k % 4 == 0 else k, "text": "ü" * (k % 3) if k % 6 else None})
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    docs = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    got = audited(docs, fan=fan, levels=levels)
    assert Counter(got) == Counter(expected(rows, fan))
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_odd_documents(odd_documents, no_documents):
    rows = [r.asDict() for r in odd_documents.collect()]
    assert Counter(audited(odd_documents)) == Counter(expected(rows))
    assert audited(no_documents) == []


def test_largest_count_and_one_row(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    rows = [{"doc_id": 7 if zlib.crc32(b"7") % 7 == 0 else next(k for k in range(99) if zlib.crc32(str(k).encode()) % 7 == 0),
             "source": "a", "lang": "en", "n_chars": 2**63 - 1, "text": "x"}]
    docs = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    (got,) = audited(docs)
    assert [got] == expected(rows) and got[1] == got[2] == got[3] and not got[-1]


def test_bad_fan(spark, no_documents):
    with pytest.raises(ValueError):
        merkle_manifest.manifest(no_documents, fan=1)
