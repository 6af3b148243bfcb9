import random

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from wiretide.llm import bpe
from wiretide.llm.oracles import ORACLES
from wiretide.llm.queries import QUERIES

STEMS = {
    "en": "the of and ing tion house water with that from river letter".split(),
    "de": "der und ung keit schön haus wasser mit daß über fluss brief".split(),
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    dice = random.Random(12)
    prose = lambda lang, n: " ".join(dice.choice(STEMS[lang]) + dice.choice(["", "s", "er", "en"]) for _ in range(n))
    rows = [(k, prose(lang, dice.randint(40, 90)), lang, f"s{k % 4}", 0) for k in range(120) for lang in [sorted(STEMS)[k % 2]]]
    item = prose("en", 14)
    copy = rows[7][1].split()
    copy[3] = "altered"
    rows += [
        (200, rows[5][1], "en", "s1", 0), (201, " ".join(copy), "de", "s2", 0), (202, "12 34 !", "en", "s1", 0), (203, None, "en", "s1", 0),
        (204, f"{prose('en', 40)} {item} {prose('en', 40)}", "en", "s1", 0), (205, item, "en", "s2", 0),
        (206, f"{prose('en', 50)} token = deadbeef{'0123456789abcdef' * 2} {prose('en', 9)}", "en", "s3", 0),
    ]
    rows = [(*r[:4], len(r[1] or "")) for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path), {r[0]: r[1] for r in rows}, item


def test_stages_and_run(spark, folder):
    path, texts, item = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path).cache()
        rows = docs.collect()
        seen[name] = {r.doc_id: r for r in rows}
        assert len(seen[name]) == len(rows)
        if name != "byte-level BPE":
            assert docs.columns == names
    kept = [set(s) for s in seen.values()]
    assert set(texts) - kept[0] == {202, 203}
    assert kept[0] - kept[1] == {200, 201}
    assert kept[1] - kept[2] == {205}
    assert kept[2] == kept[3] == kept[4]
    clean = seen["benchmark decontamination"][204].text
    assert item not in clean and clean.split() == texts[204].replace(item, "").split()
    masked = seen["secret scans"][206]
    assert "[secret]" in masked.text and "deadbeef" not in masked.text and masked.n_chars == len(masked.text)
    changed = {204, 206}
    assert all(seen["secret scans"][k].text == texts[k] for k in kept[3] - changed)
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(corpus_pipeline.VOCABULARY), special_tokens={})
    for doc, row in seen["byte-level BPE"].items():
        assert row.ids == encoding.encode_ordinary(seen["secret scans"][doc].text) and row.n_tokens == len(row.ids)
    whole = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, path).collect()}
    assert whole == {d: r.ids_sha256 for d, r in seen["byte-level BPE"].items()}


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    from verification.check import _plain

    base = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{base}/{table}.parquet'")
    ours, theirs = QUERIES[name](spark, base).toPandas(), con.sql(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert _plain(ours) == _plain(theirs)
