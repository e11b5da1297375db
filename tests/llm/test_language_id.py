import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from locatext.llm import language_id
from locatext.llm import queries as Q



def plain_buckets(text):
    """Buckets of all n-grams of a text, one by one: its words of letters, lower-cased,
    with one space before, between and after them."""
    folded = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text)
    said = " " + " ".join(folded.split()) + " "
    out = []
    for n in language_id.ORDERS:
        for at in range(len(said) - n + 1):
            gram = said[at : at + n]
            if gram.isspace():
                continue
            h = n * 0x9E3779B1 & 0xFFFFFFFF
            for c in gram:
                h = (h ^ ord(c)) * 0x85EBCA6B & 0xFFFFFFFF
                h ^= h >> 13
            out.append((h * 0xC2B2AE35 & 0xFFFFFFFF) >> 16)
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.001"
    out = Q.op2_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = out.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert n > 20 and right / n > 0.9


def test_nulls_empties_clashing_columns_and_repeats(spark):
    rows = [(i, "the cat and the dog were here", "en", "s", 1) for i in range(40)] + [(i, "der hund und die katze sind hier", "de", "s", 1) for i in range(40, 80)]
    odd = [(100, None, "en", "s", None), (101, "", None, None, 0), (102, "123 -- !!", "en", "s", 9), (None, "the dog", None, None, None), (103, "the cat", "en", "s", 7), (103, "the cat", "en", "s", 7)]
    docs = spark.createDataFrame(rows + odd, SCHEMA).withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit("y")).withColumn("k0", F.lit(0))
    out = language_id.identify(docs, language_id.fit_unheld(docs)).collect()
    got = {r["doc_id"]: r["lang_pred"] for r in out}
    assert len(out) == 86
    assert got[100] == got[101] == got[102] == "und" and got[None] == "en" and got[103] == "en" and got[50] == "de"
    assert all(0 <= r["score"] <= 1 for r in out)


def test_empty_table_and_no_labels(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert language_id.identify(docs, language_id.fit(docs)).count() == 0
    docs = spark.createDataFrame([(1, "abc", None, None, 3)], SCHEMA)
    assert language_id.identify(docs, language_id.fit(docs)).first()["lang_pred"] == "und"


@pytest.mark.parametrize("size", [7, 50])
def test_pieces_of_a_long_text_score_as_one(monkeypatch, size):
    said = ["", "Ärger mit dem Hund, and then some. " * 9, None, "...", "a", "1 bc"]
    text = pa.array(said)
    rng = np.random.default_rng(1)
    matrix = np.log(rng.random((language_id.BUCKETS, 2)).astype(np.float32))
    model = language_id.LanguageModel(["a", "b"], matrix, np.zeros(2))
    monkeypatch.setattr(language_id, "PASS_CHARS", size)
    names, scores = model.score_texts(text)
    for name, score, t in zip(names, scores, said, strict=True):
        found = plain_buckets(t or "")
        whole = model.matrix[found].sum(axis=0) if found else None
        assert (name, score) == ("und", 0.0) if whole is None else name == "ab"[whole.argmax()] and abs(score - 1 / np.exp(whole - whole.max()).sum()) < 1e-6


def test_ties_go_to_the_first_language(spark):
    docs = spark.createDataFrame([(1, "same", "b"), (2, "same", "a")], "doc_id long, text string, lang string")
    assert {(r["lang_pred"], r["score"]) for r in language_id.identify(docs, language_id.fit(docs)).collect()} == {("a", 0.5)}


def test_every_row_is_fitted_whatever_its_text(spark):
    rows = [(i, "the same text" if i % 3 else f"text {chr(97 + i % 26)} {'x' * (i % 7)}", "en" if i % 2 else "de") for i in range(12000)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    for k, lang in enumerate(model.langs):
        counts = np.zeros(language_id.BUCKETS)
        for t in (t for _, t, x in rows if x == lang):
            counts += np.bincount(plain_buckets(t), minlength=language_id.BUCKETS)
        want = np.log((counts + language_id.ALPHA) / (counts.sum() + language_id.ALPHA * language_id.BUCKETS))
        assert np.allclose(model.matrix[:, k], want, atol=1e-5)


def test_whole_table_against_one_text_at_a_time(spark):
    """op2_language_id on every document of sf0.001."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang").collect()
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in docs}
    learned = [r for r in docs if not held[r["doc_id"]] and r["text"] is not None and r["lang"] is not None]
    langs = sorted({r["lang"] for r in learned})
    counts = np.zeros((language_id.BUCKETS, len(langs)))
    for r in learned:
        np.add.at(counts, (plain_buckets(r["text"]), langs.index(r["lang"])), 1)
    matrix = np.log((counts + language_id.ALPHA) / (counts.sum(axis=0) + language_id.ALPHA * language_id.BUCKETS))
    prior = np.log([sum(r["lang"] == x for r in learned) / len(learned) for x in langs])
    got = {r["doc_id"]: r for r in Q.op2_language_id(spark, d).collect()}
    assert len(got) == len(docs)
    for r in docs:
        found, out = plain_buckets(r["text"] or ""), got[r["doc_id"]]
        total = prior + matrix[found].sum(axis=0)
        want = (langs[total.argmax()], 1 / np.exp(total - total.max()).sum()) if found else ("und", 0.0)
        assert out["held_out"] == held[r["doc_id"]] and out["lang_pred"] == want[0] and abs(out["score"] - want[1]) < 1e-3
