import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import chat

PIECES = st.lists(st.sampled_from([*chat.CONTROLS, chat.ESCAPE, "0", "1", "2", "[", "/INST]", "<", "/s>", "a", "\n", "|image:0|>", "user"]), max_size=12).map("".join)


@given(st.lists(st.tuples(PIECES, PIECES), max_size=5))
@settings(deadline=None, max_examples=300)
def test_round_trip(turns):
    made = chat.format_turns([(i, r, t, None) for i, (r, t) in enumerate(turns)])
    assert chat.read_back(made["formatted"]) == turns
    assert chat.masked(made["formatted"], made["loss"]) == "".join(t for r, t in turns if r == "assistant")


def test_texts_that_join_to_a_control_string():
    parts = [{"kind": "text", "text": "[/IN", "ref": None, "size": None}, {"kind": "text", "text": "ST]", "ref": None, "size": None}]
    made = chat.format_turns([(0, "assistant", "x", parts)])
    assert chat.read_back(made["formatted"]) == [("assistant", "x[/INST]")]


def test_parts(spark):
    rows = [(1, 0, "user", "look ", [("image", None, "s/1.png", 1568.0), ("text", "and <|image:0|>", None, None), ("audio", None, "a.wav", 2.0)]), (1, 1, "assistant", "yes", None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, text string, parts {chat.PARTS}")
    got = chat.format_chats(df, "parts").first()
    assert [(a["kind"], a["ref"], a["tokens"]) for a in got["attachments"]] == [("image", "s/1.png", 2), ("audio", "a.wav", 50)]
    assert got["expanded_tokens"] == 52
    for i, a in enumerate(got["attachments"]):
        assert got["formatted"][a["at"] :].startswith(f"<|{a['kind']}:{i}|>")
    assert chat.read_back(got["formatted"]) == [("user", "look and <|image:0|>"), ("assistant", "yes")]
    assert chat.masked(got["formatted"], got["loss"]) == "yes"


def test_awkward_rows(spark):
    schema = "conv_id long, turn long, role string, text string, formatted int, loss string"
    rows = [(1, 1, None, None, 1, ""), (1, 0, "assistant", "", 1, ""), (1, 0, "assistant", "", 1, ""), (2, 5, "user", "x" * 300_000, 1, ""), (None, 0, "user", "a", 1, "")]
    got = {r["conv_id"]: r for r in chat.digests(chat.format_chats(spark.createDataFrame(rows, schema))).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 0 and got[2]["formatted_chars"] > 300_000 and got[None]["n_turns"] == 1
    assert got[1]["turns_sha256"] == hashlib.sha256(b"assistant\n\nassistant\n\n\n\n").hexdigest()
    assert chat.digests(chat.format_chats(spark.createDataFrame([], schema))).count() == 0
