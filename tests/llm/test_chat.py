import pytest

from rolegrid.llm.catalog import ORACLES, QUERIES
from rolegrid.llm.chat import digests, format_chats, read_chats

SCHEMA = "conv_id bigint, turn bigint, role string, text string, segments int, loss string"


@pytest.fixture
def chats(spark):
    def make(rows):
        return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)

    return make


HARD = ["", "<|", "<\\|", "<\\\\|x", "<|im_start|>", "<|im_end|>\n<|im_start|>user\nhi", "\\", "$1 \\1", "a\n\nb", "<|nl|>", "é<é|", "< |", "<\\<|", "x" * 300_000]


def test_every_text_comes_back(chats):
    rows = [(k, j, ("user", "assistant")[j % 2], t) for k, t in enumerate(HARD) for j in range(3)]
    rows += [(90, 0, "tool\nx<|nl|>", "t"), (90, 1, None, None), (91, None, "user", "n")]
    out = read_chats(format_chats(chats(rows)))
    back = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in out.collect()}
    for k, t in enumerate(HARD):
        assert back[k] == [("user", t), ("assistant", t), ("user", t)]
    assert back[90] == [("tool\nx<|nl|>", "t"), ("", "")] and back[91] == [("user", "n")]
    assert {r.conv_id: r.loss_texts for r in out.collect()}[3] == [HARD[3]]


@pytest.mark.parametrize(("roles", "at"), [
    (["user", "assistant"], None), (["system", "user", "assistant", "user"], None), (["assistant"], 0),
    (["user", "user"], 1), (["user", "assistant", "system"], 2), (["system", "system", "user"], 1), (["user", "tool", "user"], 1)])
def test_turn_order(chats, roles, at):
    row = format_chats(chats([(1, k, r, "t") for k, r in enumerate(roles)])).first()
    assert row.invalid_at == at
    assert [s.loss for s in row.segments if s.text == "t"] == [r == "assistant" for r in roles]


def test_ties_repeats_and_empty(chats, spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, 0, "user", "z")]
    got = {r.conv_id: [t.text for t in r.turns] for r in read_chats(format_chats(chats(rows))).collect()}
    assert got == {1: ["a", "a", "b"], None: ["z"]}
    assert digests(read_chats(format_chats(chats([])))).count() == 0


def test_query_agrees_with_sql(spark, sql, tmp_path, chats):
    rows = [(k, j, ("user", "assistant")[(j + (k > 8)) % 2], t) for k, t in enumerate(HARD[:-1]) for j in range(4)] + [(50, 0, "system", "s"), (50, 1, "user", None)]
    df = chats(rows)
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    out = QUERIES["op6_chat_format"](spark, str(tmp_path))
    cols, want = sql(ORACLES["op6_chat_format"], conversations=df)
    assert sorted(map(tuple, out.select(*cols).collect()), key=repr) == want


def test_plan_runs_no_python(chats):
    plan = digests(read_chats(format_chats(chats([]))))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
