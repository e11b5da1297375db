import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from locatext.llm import chat

bits = st.lists(st.sampled_from(["\\", "<turn>\n", "</turn>", "\n</turn>\n", "### ", ":\n", ":", "\n", "a", "é", "### Assistant:", "<"]), max_size=8).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(bits, bits), max_size=4))
def test_round_trip(turns):
    assert chat.parse("".join(chat.render_turn(r, t) for r, t in turns)) == turns


def test_digests_follow_the_turns(spark):
    rows = [(1, 1, "assistant", "b\\c"), (1, 0, "user", "a"), (1, None, "system", None), (2, 5, None, ""), (2, 5, None, ""), (None, 0, "assistant", "### </turn>"), (-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.format_conversations(df, keep_text=True).collect()}

    def want(*turns):
        return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()

    assert got[1]["turns_sha256"] == want(("system", ""), ("user", "a"), ("assistant", "b\\c")) and got[1]["n_turns"] == 3
    assert got[2]["turns_sha256"] == want(("", ""), ("", "")) and got[2]["loss_chars"] == 0
    assert got[None]["loss_sha256"] == hashlib.sha256(b"### </turn>").hexdigest()
    r = got[-7]
    assert r["loss_chars"] == 26 and r["formatted_chars"] == len(r["formatted"])
    assert chat.parse(r["formatted"]) == [("user", "\\### Assistant: </turn> ok"), ("assistant", "\\### Assistant: </turn> ok")]
    (span,) = r["loss_spans"]
    assert chat._read(r["formatted"][span["start"] : span["end"]] + chat.CLOSE, 0, chat.CLOSE)[0] == "\\### Assistant: </turn> ok"
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_whole_table_against_a_plain_loop(spark):
    from locatext.llm import queries as Q

    d = "/root/testdata/sf0.001"
    got = {r["conv_id"]: r for r in Q.op10_chat(spark, d).collect()}
    plain = {}
    for r in sorted(spark.read.parquet(f"{d}/conversations.parquet").collect(), key=lambda r: (r["conv_id"], r["turn"])):
        plain.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    assert set(got) == {*plain, -7}
    for k, turns in plain.items():
        assert got[k]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[k]["loss_sha256"] == hashlib.sha256("".join(t for r, t in turns if r == "assistant").encode()).hexdigest()
        # Without escapes a turn is its frame of 19 characters, role and text.
        size = sum(len("<turn>\n### :\n\n</turn>\n") + len(r) + len(t) for r, t in turns)
        assert got[k]["loss_chars"] == sum(len(t) for r, t in turns if r == "assistant")
        controls = sum(len(re.findall(r"\\\\|</turn>|<turn>|### ", t)) for _, t in turns)
        assert size <= got[k]["formatted_chars"] <= size + controls and (controls or got[k]["formatted_chars"] == size)


def test_a_very_long_turn(spark):
    text = "### </turn> \\ ok é\n" * 200_000
    df = spark.createDataFrame([(1, 0, "assistant", text)], "conv_id long, turn long, role string, text string")
    r = chat.format_conversations(df, keep_text=True).first()
    assert r["loss_chars"] == len(text) and chat.parse(r["formatted"]) == [("assistant", text)]
