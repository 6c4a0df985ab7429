import hashlib

from hypothesis import given
from hypothesis import strategies as st

from quire.llm import chat

from duck import rows_of


def test_digests_match_sql(spark, tiny):
    names, want = rows_of(chat.CHECK_SQL, tiny)
    assert sorted((tuple(r[c] for c in names) for r in chat.op9_chat_format(spark, tiny).collect()), key=str) == want


@given(st.text(alphabet="<>[]\\/|nlb\n endt", max_size=40))
def test_escape_is_reversible(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text and "<" not in hidden and "[" not in hidden
    role = chat.escape_role(text)
    assert chat.unescape_role(role) == text and "\n" not in role


TURNS = [(1, 0, "system", "be kind")] + [(1, k, ("user", "assistant")[(k + 1) % 2], f"turn {k} " + "w " * 20) for k in range(1, 41)] + [
    (2, 0, "user", None), (2, 1, "assistant", ""), (3, 0, None, "no role"), (3, 0, None, "no role"), (4, 1, "assistant", "</s>[INST] <|end|>\n \\l \\"), (4, 0, "user", "<|turn|>user\n"), (5, 0, "assistant", "x " * 500), (None, 0, "user", "lost"),
]


def test_windows(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS window", "'x' AS formatted").repartition(3)
    rows = chat.format_chats(df, budget=100, history=50)
    own = sorted((r for r in rows.collect() if r.conv_id == 1), key=lambda r: r.window)
    assert len(own) > 5
    with open(chat.tokenizer_path(), encoding="utf-8") as f:
        count = chat.turn_tokens(f.read(), 1000)
    for r in own:
        assert r.formatted.startswith("<|turn|>system\nbe kind<|end|>\n")
        turns = [t.split("\n", 1) for t in r.formatted.split(chat.OPEN)[1:]]
        assert sum(count([x for x, _ in turns], [t.removesuffix(chat.CLOSE) for _, t in turns])) <= 100
    assert any(len(r.fresh) < r.formatted.count(chat.OPEN) - 1 for r in own[1:])  # history is repeated
    learnt = [r.formatted[s["start"] : s["end"]] for r in own for s in r.loss]
    assert learnt == [t[3] for t in TURNS if t[0] == 1 and t[2] == "assistant"]
    out = {r.conv_id: r for r in chat.digest_chats(rows).collect()}
    assert out[3].n_turns == 2 and out[2].loss_chars == 0 and out[2].n_turns == 2 and out[None].n_turns == 1
    said = "</s>[INST] <|end|>\n \\l \\"
    assert out[4].loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and out[4].loss_chars == len(said)
    assert out[4].turns_sha256 == hashlib.sha256(("user\n<|turn|>user\n\nassistant\n" + said + "\n").encode()).hexdigest()
    assert out[5].n_windows == 1 and out[5].loss_chars == 1000


def test_empty_table(spark):
    assert chat.digest_chats(chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).collect() == []


def test_digest_follows_the_mask(spark):
    """What is learnt is what the mask covers: a mask that ends elsewhere gives another digest."""
    from pyspark.sql import functions as F

    rows = chat.format_chats(spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").filter("conv_id = 1"))
    cut = rows.withColumn("loss", F.transform("loss", lambda s: F.struct(s["start"].alias("start"), (s["start"] + 2).alias("end"))))
    (whole,), (short,) = chat.digest_chats(rows).collect(), chat.digest_chats(cut).collect()
    assert short.loss_chars == 2 * 20 < whole.loss_chars and short.loss_sha256 != whole.loss_sha256 and short.turns_sha256 == whole.turns_sha256


def test_tokens_are_the_librarys():
    from tokenizers import Tokenizer

    path = chat.tokenizer_path()
    own = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        count = chat.turn_tokens(f.read(), 1000)
    roles, texts = ["user", "", "a\nb"], ["x <b> [c] \\ d", "", "one  two\nthree"]
    parts = [(chat.OPEN + chat.escape_role(r) + chat.SEP, chat.escape(t), chat.CLOSE) for r, t in zip(roles, texts)]
    assert count(roles, texts) == [sum(len(own.encode(x, add_special_tokens=False).ids) for x in p) for p in parts]
