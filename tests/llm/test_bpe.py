import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from locatext.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    return bpe.ByteBpe(open(PATH, encoding="utf-8").read()), Tokenizer.from_file(PATH)


ODD = ["", " ", "a", "\n\n  x", "don't we'll I'M", "x" * 300, "ab" * 200 + "!", "0123456789" * 9, "日本語のテキスト 🎉🎉 é́", "a<|endoftext|>b <|endoftext|>", "<|endoftext|", "tab\tend  ", "  x　", "a\x1cb\x1d \x85 c", "Ⅷ ½ ²", "​﻿ z", "a" + "́" * 30]


def test_same_ids_and_text_as_the_library(both):
    own, lib = both
    rnd = random.Random(5)
    texts = ODD + ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0x80, 0x3000), 32, 10])) for _ in range(rnd.randrange(400))) for _ in range(200)]
    for t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids, repr(t)
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_every_code_point_is_split_alike(both):
    own, lib = both
    for lo in range(0, 0x30000, 0x400):
        t = " ".join(f"a{chr(c)}1{chr(c)}" for c in range(lo, lo + 0x400) if not 0xD800 <= c < 0xE000)
        if t:
            assert own.encode(t) == lib.encode(t, add_special_tokens=False).ids, hex(lo)


def test_long_words_merge_in_the_same_order(both, monkeypatch):
    own, _ = both
    rnd = random.Random(3)
    for _ in range(300):
        w = bytes(rnd.choice(b"abethnio ") for _ in range(rnd.randrange(2, 47)))
        assert own.encode_word(w) == own._encode_long([own.byte_ids[b] for b in w]) == own.encode_words([w])[0]


def test_pieces_and_full_memo_change_nothing(both, monkeypatch):
    own, lib = both
    text = "The quick  brown\n\n fox, doesn't 12 " * 60
    monkeypatch.setattr(bpe, "PIECE_CHARS", 17)
    monkeypatch.setattr(bpe, "MEMO_WORDS", 5)
    own.runs.clear()
    ids = lib.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids
    n, a, b = bpe.digests(own.encode_iter(text))
    assert [bpe.digests(x) for x in own.encode_many([text, text[:9]])][0] == (n, a, b)
    assert (n, a, b) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_long_runs_do_not_pile_up_in_the_memo(both, monkeypatch):
    own, lib = both
    monkeypatch.setattr(bpe, "MEMO_CHARS", 5000, raising=False)
    own.runs.clear()
    rnd = random.Random(7)
    texts = ["x " + "".join(rnd.choice("abcdefghij日本語") for _ in range(400)) + " the" for _ in range(60)]
    for t in texts:
        (found,) = own.encode_many([t])
        assert ",".join(said for said, _, _ in found) == ",".join(map(str, lib.encode(t, add_special_tokens=False).ids))
        assert sum(map(len, own.runs)) <= 5000


def test_rows(spark, both):
    rows = [(1, None, "x"), (2, "", "x"), (3, "hi there", "x"), (3, "hi there", "x"), (None, "hi", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(bpe.encode_decode(docs, PATH, keep_ids=True).collect(), key=str)
    assert len(got) == 5
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_tokens"] == by[2]["n_tokens"] == 0 and by[1]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert by[3]["ids"] == both[1].encode("hi there").ids and by[3]["decoded"] == "hi there"
    assert bpe.encode_decode(docs.limit(0), PATH).count() == 0


def test_plain_runs_have_the_words_of_the_pattern():
    rnd = random.Random(8)
    kinds = ["aB", "éßÖ", "ɏǅƻ", "×÷", ".,&$#*|!", "'", "\n", "1", " ", "\t"]
    for _ in range(20000):
        run = "".join(rnd.choice(rnd.choice(kinds)) for _ in range(rnd.randrange(1, 7)))
        if not run[0].isspace():
            assert bpe._words_of(run) == bpe.WORDS.findall(" " + run), repr(run)


def test_texts_are_cut_at_breaks():
    rnd = random.Random(9)
    for _ in range(5000):
        text = "".join(rnd.choice("aé. \n \t\x1c\u3000") for _ in range(rnd.randrange(9)))
        assert bpe._cut(text) == bpe._BREAK.split(text), repr(text)


def test_whole_table_against_the_library(spark, both):
    """op5_bpe on every document of sf0.001."""
    from locatext.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in QUERIES["op5_bpe"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = both[1].encode(r["text"] or "", add_special_tokens=False).ids
        said = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        text = hashlib.sha256(both[1].decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert (len(ids), said, text) == tuple(got[r["doc_id"]][c] for c in ("n_tokens", "ids_sha256", "decoded_sha256"))
