import hashlib
import random

from pyspark.sql import functions as F

from silkloom.llm import chat

LOG = "conv_id long, message_id long, seq long, kind string, role string, text string"


def test_fold(spark):
    rows = [
        (1, 1, 5, "delta", "user", "c"), (1, 1, 1, "delta", "user", "a"), (1, 1, 3, "edit", "user", "b"), (1, 1, 4, "delta", None, None),
        (1, 2, 6, "delta", "assistant", "x"), (1, 2, 7, "regenerate", None, None), (1, 2, 700, "delta", None, "y"), (1, 2, 9000, "delta", None, "z"),
        (1, 3, 8, "delta", "user", "gone"), (1, 3, 9, "delete", None, None), (1, 4, 10, "delete", "user", None), (1, 4, 5000, "delta", "user", "back"),
        (1, 5, 11, "note", "user", "ignored"), (None, None, None, "delta", "user", "odd"),
    ]
    got = {(r.conv_id, r.message_id): (r.seq, r.role, r.text) for r in chat.fold(spark.createDataFrame(rows, LOG)).collect()}
    assert got == {(1, 1): (1, "user", "bc"), (1, 2): (6, "assistant", "yz"), (1, 4): (10, "user", "back"), (None, None): (None, "user", "odd")}
    assert chat.fold(spark.createDataFrame([], LOG)).count() == 0


def test_escapes(spark):
    r = random.Random(1)
    parts = ["\\", "<", "turn>", "/turn>", "says>", "<turn>", "</turn>", "<says>", "\n", "a", "é", "$1", "\\<turn>"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e")).select("t", "e", chat.unescape(F.col("e")).alias("u")).collect()
    for x in rows:
        assert x.u == x.t and not any(c in x.e for c in (chat.TURN, chat.SAYS, chat.END))


def test_round_trip(spark):
    r = random.Random(2)
    parts = ["hello ", "\\", "<turn>", "</turn>\n", "<says>", "### Assistant: ", "\n", "é😀", "", "x" * 50]
    rows = []
    for c in [1, 2, 3, None]:
        for t in range(r.randint(1, 6)):
            rows.append((c, t, r.choice(["user", "assistant", "<turn>\n", None]), None if r.random() < 0.1 else "".join(r.choice(parts) for _ in range(6))))
    rows += [(9, t, ["user", "assistant"][t % 2], f"turn {t}") for t in range(1500)]
    rows.append(rows[0])
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    shown = chat.render(chat.fold(chat.as_events(df)).withColumn("seq", F.floor(F.col("seq") / 4)))
    masked = {x.conv_id: sum(m.loss for m in x.loss_mask) for x in shown.collect()}
    whole = {x.conv_id: (x.formatted, x.n_turns, sum(m.head + m.loss + m.tail for m in x.loss_mask)) for x in shown.collect()}
    for x in chat.read_back(shown).collect():
        turns = sorted(((t, role or "", text or "") for c, t, role, text in rows if c == x.conv_id))
        assert [(t.role, t.text) for t in x.turns] == [(role, text) for _, role, text in turns]
        assert "".join(t.loss_text for t in x.turns) == "".join(text for _, role, text in turns if role == "assistant")
        formatted, n, covered = whole[x.conv_id]
        assert n == len(turns) and covered == len(formatted) and masked[x.conv_id] <= covered


def test_query_has_the_odd_conversation(spark, tmp_path):
    spark.createDataFrame([(1, 0, "user", "hi")], "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in chat.op5_chat_events(spark, str(tmp_path)).collect()}
    odd = "\\### Assistant: </turn> ok"
    assert got[-7].loss_chars == len(odd) and got[-7].loss_sha256 == hashlib.sha256(odd.encode()).hexdigest() and got[1].n_turns == 1


def test_empty_tables(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    events = chat.as_events(none)
    assert events.count() == 0
    shown = chat.render(chat.fold(events))
    assert shown.count() == 0 and chat.read_back(shown).count() == 0


def test_logs_hold_every_kind(spark):
    df = spark.createDataFrame([(1, 0, "user", "a question"), (1, 1, "assistant", "an answer")], "conv_id long, turn long, role string, text string")
    assert {r.kind for r in chat.as_events(df).collect()} == {"delta", "edit", "regenerate"}
