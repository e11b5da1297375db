import hashlib

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from locatext.llm import decontaminate, language_id

from .test_decontaminate import brute as leaks
from .test_decontaminate import plain_words
from .test_near_dedup import LOWER
from .test_near_dedup import brute as near

D = "/root/testdata/sf0.001"


def test_against_brute_force(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    model = language_id.fit_unheld(docs)
    good = {r["doc_id"] for r in language_id.identify(docs, model).collect() if r["lang_pred"] != "und" and r["score"] >= 0.5}
    rows = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in good}
    last = {}
    for i in sorted(rows):
        last[(rows[i] or "").translate(LOWER)] = i
    rows = {i: rows[i] for i in last.values()}
    kept = near(list(rows.items()), 5)
    rows = {i: t for i, t in rows.items() if kept[i][2]}
    items = [tuple(r) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    runs = lambda t: {tuple(w[i : i + 5]) for w in [plain_words(t)] for i in range(len(w) - 4)}
    of_item = [(i, b, runs(b)) for i, b in items]
    bad = {i for i, t in rows.items() if leaks([(i, t)], [(k, b) for k, b, s in of_item if s & runs(t)])}
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, t in rows.items():
        if i not in bad:
            ids = lib.encode(t, add_special_tokens=False).ids
            want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = {r["doc_id"]: tuple(r)[1:] for r in P.run(spark, D).collect()}
    assert got == want and bad


def test_stages_on_odd_and_empty_tables(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (2, "The cat", None, None, 7), (2, "The cat", None, None, 7)], docs.schema)
    for table in (docs.limit(0), odd):
        x = table
        for _, stage in P.STAGES[:-1]:
            x = stage(spark, x, D)
            assert x.columns == docs.columns
            x.count()
        assert P.STAGES[-1][1](spark, x, D).count() == x.count()


def test_item_text_alone_is_a_leak(spark):
    item = spark.read.parquet(f"{D}/benchmark.parquet").first()
    docs = spark.createDataFrame([(1, item["text"]), (2, "clean words only here")], "doc_id long, text string")
    assert [r["doc_id"] for r in P.decontamination_stage(spark, docs, D).collect()] == [2]
    assert decontaminate.COVERAGE == 0.5


def test_columns_of_any_name_pass_through(spark):
    """Names that the operators use themselves do not clash."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    extra = ["lang_pred", "score", "__id", "__stay", "id", "tag", "key", "norm", "k0", "kept", "component_id", "n_shingles"]
    wide = docs
    for c in extra:
        wide = wide.withColumn(c, docs["doc_id"])
    for name, stage in P.STAGES[:-1]:
        got = stage(spark, wide, D)
        assert got.columns == wide.columns, name
        rows = got.collect()
        assert rows and all(r[c] == r["doc_id"] for r in rows for c in extra), name
        assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in stage(spark, docs, D).collect()}, name
