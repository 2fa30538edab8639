import random

from procura.llm import chat


def test_round_trip_masks_every_assistant_text_once(spark):
    rng = random.Random(5)
    bits = ["hello", "<|im_start|>", "<|im_end|>", "␛", "␛/", "</s>", "[INST]", "<<SYS>>", "\n", "<", "|im_end|>", "word " * 60, "[[INST]", "<␛/s>", "\\"]
    rows = []
    for c in range(25):
        for t in range(rng.randint(1, 12)):
            rows.append((c, t, rng.choice(["user", "assistant", "system"]) if t else rng.choice(["system", "user"]), "".join(rng.choices(bits, k=rng.randint(0, 6)))))
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for budget, history in ((2048, 512), (60, 40), (1, 0)):
        formatted = chat.format_conversations(df, budget, history)
        for r in chat.read_back(formatted).collect():
            own = sorted(x for x in rows if x[0] == r.conv_id)
            assert [(t.role, t.text) for t in r.turns] == [(x[2], x[3]) for x in own]
            assert r.loss_text == "".join(x[3] for x in own if x[2] == "assistant")
        for r in formatted.collect():
            body = r.formatted.replace("<|im_start|>", "").replace("<|im_end|>", "")
            assert not any(c in body for c in chat.CONTROLS)
            assert r.formatted.count("<|im_start|>") > r.n_repeated


def test_windows_keep_the_system_turn_and_bounded_history(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, t, "user" if t % 2 else "assistant", f"turn{t} " * 20) for t in range(1, 31)]
    windows = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 200, 60).orderBy("window").collect()
    assert len(windows) > 3 and all("be kind" in w.formatted for w in windows)
    assert all(1 <= w.n_repeated <= 3 for w in windows[1:])


def test_nulls_ties_repeats_and_foreign_columns(spark):
    rows = [(None, None, None, None, 1), (2, 0, "a\nb␛␤", "x", 1), (2, 0, "a\nb␛␤", "x", 1), (3, None, "assistant", "z", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window int")
    found = {r.conv_id: ([tuple(t) for t in r.turns], r.loss_text) for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert found == {None: ([("", "")], ""), 2: ([("a\nb␛␤", "x")] * 2, ""), 3: ([("assistant", "z")], "z")}
    assert chat.read_back(chat.format_conversations(df.limit(0))).collect() == []
