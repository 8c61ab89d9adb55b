"""Chat formatting: digests against brute force, exact round trip, typed parts."""

import hashlib

from rillwork.llm.chat_format import CHECK_TEXT, PART, chat_digests, format_conversations, read_back

TRICKY = ["", None, "\\", "<|end|>", "\\<|end|>", "<\\|text|>", "a<|role|>b\\\\<|", "é漢\U0001f600\n", "x" * 50_000, "<||>", "<<|", "$1 \\1"]


def hexed(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows):
    by_conv = {}
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, []).append((turn, role, text or ""))
    by_conv[-7] = [(0, "user", CHECK_TEXT), (1, "assistant", CHECK_TEXT)]
    out = {}
    for conv, turns in by_conv.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hexed("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), hexed(loss))
    return out


def test_digests_equal_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").selectExpr("conv_id", "turn", "role", "text")
    extra = [(900_000 + i % 2, i, ("user", "assistant", "system")[i % 3], t) for i, t in enumerate(TRICKY)]
    table = table.unionByName(spark.createDataFrame(extra, table.schema))
    want = brute([tuple(r) for r in table.collect()])
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat_digests(table.selectExpr("*", "1 as turn_no", "2 as piece")).collect()}
    assert got == want


def test_parts_keep_order_and_count_tokens(spark):
    part = lambda kind, text=None, uri=None, width=None, height=None, seconds=None, pages=None: (kind, text, uri, width, height, seconds, pages)
    content = [part("text", "see <|image|> "), part("image", uri="i", width=57, height=28), None, part("odd"), part("audio", uri="a", seconds=1.5), part("document", uri="d"), part("text", " end")]
    rows = [(1, 0, "user", content), (1, 1, "assistant", [part("text", "ok")]), (2, 0, None, None)]
    made = format_conversations(spark.createDataFrame(rows, f"conv_id long, turn long, role string, content array<{PART}>"))
    one, two = made.orderBy("conv_id").collect()
    assert one["formatted"] == "<|role|>user<|text|>see \\l|image|> <|image|><|audio|><|document|> end<|end|><|role|>assistant<|text|>ok<|end|>"
    assert [(a["turn_no"], a["kind"], a["uri"], a["tokens"]) for a in one["attachments"]] == [(0, "image", "i", 3), (0, "audio", "a", 38), (0, "document", "d", 512)]
    assert one["n_expanded"] == 553
    assert [one["formatted"][s["start"] : s["start"] + s["length"]] for s in one["loss_spans"]] == ["ok"]
    assert two["formatted"] == "<|role|><|text|><|end|>" and two["attachments"] == []
    turn = read_back(made).orderBy("conv_id").first()["turns"][0]
    assert turn["text"] == "see <|image|> <|image|><|audio|><|document|> end"
    assert turn["placeholders"] == ["image", "audio", "document"]


def test_text_parts_side_by_side_form_no_control_string(spark):
    texts = [["a<", "|end|>b"], ["<|", "image|>"], ["\\", "l|end|>"], ["<", "<", "|text|>"], ["\\b<", "\\"], ["<|end|", ">"], ["ends <"]]
    rows = [(k, 0, "user", [("text", t, None, None, None, None, None) for t in parts]) for k, parts in enumerate(texts)]
    back = read_back(format_conversations(spark.createDataFrame(rows, f"conv_id long, turn long, role string, content array<{PART}>"))).collect()
    assert {r["conv_id"]: [(t["role"], t["text"], t["placeholders"]) for t in r["turns"]] for r in back} == {k: [("user", "".join(parts), [])] for k, parts in enumerate(texts)}


def test_nulls_ties_and_empty_table(spark):
    schema = "conv_id long, turn long, role string, text string"
    got = {r["conv_id"]: r for r in chat_digests(spark.createDataFrame([(None, None, None, None), (5, 1, "user", "b"), (5, 1, "user", "a"), (5, 1, "user", "a")], schema)).collect()}
    assert got[None]["n_turns"] == 1 and got[None]["turns_sha256"] == hexed("\n\n")
    assert got[5]["n_turns"] == 3 and got[5]["turns_sha256"] == hexed("user\na\nuser\na\nuser\nb\n")
    assert [r["conv_id"] for r in chat_digests(spark.createDataFrame([], schema)).collect()] == [-7]
