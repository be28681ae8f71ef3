from oddsframe.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def conv(i, *texts):
    return [(i, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(texts)]


def formatted(spark, rows, extra=False):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        df = df.selectExpr("*", "'x' as rank", "'y' as h1", "'z' as part")
    return {(r.conv_id, r.part): (r.n_turns, r.rendered) for r in chat.format_chats(df).collect()}


def test_prefixes_go_and_of_equal_ones_the_least_id_stays(spark):
    rows = conv(1, "a", "b") + conv(2, "a", "b", "c") + conv(3, "a", "b", "c") + conv(4, "a", "x") + conv(5, "a") + conv(6, "b", "a")
    out = formatted(spark, rows, extra=True)
    assert sorted(k for k, _ in out) == [2, 4, 6]
    assert out[2, 0] == (3, "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\nc<|im_end|>\n")


def test_order_matters_and_joined_texts_dont_collide(spark):
    out = formatted(spark, conv(1, "ab", "c") + conv(2, "a", "bc") + conv(3, "c", "ab"))
    assert sorted(k for k, _ in out) == [1, 2, 3]


def test_long_conversations_cross_chunks(spark):
    n = chat.CHUNK * 2 + 5
    long = [str(i % 7) for i in range(n)]
    rows = conv(1, *long[:-1]) + conv(2, *long) + conv(3, *long[: chat.CHUNK])
    out = formatted(spark, rows)
    assert sorted(out) == [(2, 0)] and out[2, 0][0] == n and out[2, 0][1].count("<|im_start|>") == n
    cut = {r.part: r for r in chat.format_chats(spark.createDataFrame(rows, SCHEMA), turns_a_row=chat.CHUNK).collect()}
    assert sorted(cut) == [0, 1, 2] and cut[2].n_turns == 5
    assert "".join(cut[p].rendered for p in range(3)) == out[2, 0][1]


def test_very_long_texts_and_clashing_columns(spark):
    rows = conv(1, "x" * 2_000_000, "b") + conv(2, "x" * 2_000_000, "b", "c")
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA + ", chunk long, n_turns long, rendered long")
    (r,) = chat.format_chats(df).collect()
    assert (r.conv_id, r.n_turns) == (2, 3) and len(r.rendered) > 2_000_000


def test_nulls_repeats_and_empty(spark):
    assert formatted(spark, []) == {}
    rows = [(None, 0, "user", "x"), (1, None, "user", None), (1, 0, None, "b"), (2, 0, "user", "t"), (2, 0, "user", "t")]
    out = formatted(spark, rows)
    assert out[1, 0] == (2, "<|im_start|>user\n<|im_end|>\n<|im_start|>\nb<|im_end|>\n") and out[2, 0][0] == 2 and len(out) == 2
