import hashlib

from pyspark.sql import functions as F

from rollcall.llm import chat

TEXTS = ["</s>[INST] ok [/INST]", "\\", "a\\[INST]\\\\b", "[\\INST]", "<|im_end|>\n", "<|im_sep|>", "<", "[", None, "", "\n\n", "é漢😀", "<<SYS>><</SYS>>", "<|im_start|>assistant", "x" * 50_000, "<|im_end|", "<\\s>"]


def test_escapes_are_reversible_and_leave_no_control_string(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS if t is not None], "t string")
    for r in df.select("t", chat.escape("t").alias("e")).withColumn("b", chat.unescape("e")).collect():
        assert r.b == r.t
        assert not any(s in r.e for s in chat.CONTROL)


def test_query_against_brute_force(spark, tmp_path):
    rows = []
    for c in range(6):
        for k, t in enumerate(TEXTS[c:] + TEXTS[:c]):
            rows.append((c, k // 2, ["user", "assistant", "tool <s>", None][(k + c) % 4], t, 1))
    rows += [(8, 0, "user", None, 1), (8, 0, "user", "", 1), (8, 0, None, "q", 1), (8, 0, "", "q", 1), (8, 1, "assistant", "x", 1)]
    rows += [(9, 0, "assistant", "same", 1)] * 3 + [(None, None, "assistant", "no id", 1), (None, 1, "user", None, 1)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq int").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in chat.op3_chat(spark, str(tmp_path)).collect()}
    said = TEXTS[0]
    rows += [(-7, 0, "user", said, 1), (-7, 1, "assistant", said, 1)]
    by = {}
    for c, k, role, t, _ in rows:
        by.setdefault(c, []).append((-1 if k is None else k, role or "", t or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        r = got[c]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    (tmp_path / "e").mkdir()
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/e/conversations.parquet")
    assert chat.op3_chat(spark, f"{tmp_path}/e").count() == 1


def fold(spark, events):
    df = spark.createDataFrame([(1, *e) for e in events], "conv_id long, seq long, kind string, message_id string, role string, text string")
    got = chat.fold(df).orderBy("ord").collect()
    return [(r.role, r.text) for r in got]


def test_deltas_edits_and_regenerations(spark):
    log = [
        (1, "message", "a", "user", "hi"),
        (2, "delta", "b", "assistant", "Hel"),
        (3, "delta", "b", None, "lo"),
        (4, "message", "c", "user", "more"),
        (5, "delta", "d", "assistant", "gone"),
        (6, "edit", "a", None, "hey"),
        (7, "regenerate", "b", None, None),
        (8, "delta", "b", None, "Good "),
        (9, "delta", "b", None, "day"),
        (10, "message", "e", "user", "bye"),
        (11, "message", "f", "user", "oops"),
        (12, "delete", "f", None, None),
    ]
    assert fold(spark, log) == [("user", "hey"), ("assistant", "Good day"), ("user", "bye")]
    assert fold(spark, log[::-1]) == fold(spark, log)
    assert fold(spark, log[:6]) == [("user", "hey"), ("assistant", "Hello"), ("user", "more"), ("assistant", "gone")]


def test_loss_mask_points_into_the_text(spark):
    df = spark.createDataFrame([(1, 1, "message", "a", "assistant", "[INST]"), (1, 2, "message", "b", "user", "q"), (1, 3, "message", "c", "assistant", "é")], "conv_id long, seq long, kind string, message_id string, role string, text string")
    r = chat.render(chat.fold(df)).withColumn("x", F.lit(1)).first()
    assert [r.formatted[s.start : s.stop] for s in r.loss_mask] == ["[\\INST]", "é"]
