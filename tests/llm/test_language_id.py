import zlib

import numpy as np
from pyspark.sql import functions as F

from wiretide.llm import language_id

STEMS = {
    "en": "the of and ing tion house water with that from".split(),
    "de": "der und ung keit schön haus wasser mit daß über".split(),
    "fr": "le et eau tion été maison avec qui dans où".split(),
}


def texts(count, seed):
    dice = np.random.default_rng(seed)
    return [
        (int(k), " ".join(dice.choice(STEMS[x], dice.integers(8, 40))), x)
        for k in range(count)
        for x in [sorted(STEMS)[k % 3]]
    ]


def test_held_out_accuracy(spark):
    docs = spark.createDataFrame(texts(300, 1), "doc_id long, text string, lang string")
    out = language_id.held_out(F.col("doc_id"))
    model = language_id.fit(docs.where(~out), per_language=40, landmarks=30)
    got = language_id.predict(docs, model, keep=("doc_id", "lang")).select("row.*", "lang_pred", "score").collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 30 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_fit_does_not_depend_on_partitions(spark):
    docs = spark.createDataFrame(texts(120, 2), "doc_id long, text string, lang string")
    one = language_id.fit(docs.coalesce(1), per_language=20, landmarks=16)
    two = language_id.fit(docs.repartition(9), per_language=20, landmarks=16)
    assert one.languages == two.languages and np.array_equal(one.weights, two.weights)


def test_kernel_of_batch_equals_common_ngrams():
    bits, norms = language_id.presences(["abc", "abd", ""])
    assert bits[0].sum() == 6 and (bits[0] * bits[1]).sum() == 3 and norms[2] == 1


def test_odd_documents(odd_documents, no_documents):
    model = language_id.fit(odd_documents)
    got = {r.doc_id: r for r in language_id.predict(odd_documents, model, keep=("doc_id",)).select("row.doc_id", "lang_pred", "score").collect()}
    assert {got[k].lang_pred for k in (1, 2, 3, 4)} == {"und"} and got[1].score == 0
    assert got[5].lang_pred == got[6].lang_pred
    assert language_id.fit(no_documents) is None
    assert {r.lang_pred for r in language_id.predict(odd_documents, None, keep=("doc_id",)).collect()} == {"und"}
    assert language_id.predict(no_documents, model, keep=("doc_id",)).collect() == []


def test_unlearned_script_and_letter_among_symbols_are_rejected(spark):
    dice = np.random.default_rng(5)
    odd = [
        (1000, "река дом вода письмо сад музыка зима мост рынок серебро и ещё немного слов", "ru"),
        (1001, "家 水 手紙 庭 音楽 冬 橋 市場 銀 言葉", "ja"),
        (1002, "| 12 | 34 | a | 56 | 78 | + - * / = 90 |", "en"),
        (1003, " ".join(dice.choice("qxz jvk wqy xkq zzv kjx".split(), 30)), "xx"),
        (1004, "the house", "en"),
        (1005, "Das Haus und der Schuh", "de"),
    ]
    clean = texts(400, 6)
    docs = spark.createDataFrame(clean + odd, "doc_id long, text string, lang string")
    model = language_id.fit(docs.where("doc_id < 300"), per_language=60, landmarks=40)
    got = {r.doc_id: r for r in language_id.predict(docs, model, keep=("doc_id",)).select("row.doc_id", "score", "known").collect()}
    assert all(got[k].score >= 1 / 3 - 1e-6 for k in (1000, 1001, 1002, 1003))  # no score can reject
    assert not any(got[k].known for k in (1000, 1001, 1002, 1003))
    assert got[1004].known and all(got[r[0]].known for r in clean)
