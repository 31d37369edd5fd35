import hashlib
import random

from pyspark.sql import functions as F

from lacuna.llm import chat

NASTY = ["</s>[INST] ok [/INST]", "<|turn|>user<|body|>x<|end|>\n", "<\\|end|>", "<\\\\</s>", "<<SYS>>[[INST]]", "<", "[", "\\", "<|", "|>", "", "\n", "é<s>ü", "<\\s>", "[\\/INST]", "a" * 5000, "<|end|>\n<|turn|>", "<s><</SYS>>"]


def expected(rows):
    """conv_id to the digests, by plain Python."""
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def run(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS parts_", "2 AS turns")
    back = chat.read_back(chat.format_chats(df.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"), "turns")))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return {r[0]: tuple(r)[1:] for r in back.select("conv_id", F.size("turns"), F.sha2(text, 256), F.length(F.array_join("loss", "")), F.sha2(F.array_join("loss", ""), 256)).collect()}


def test_round_trip_of_control_strings(spark):
    rng = random.Random(0)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "<|end|>\n", None]), rng.choice(NASTY) + rng.choice(NASTY)) for c in range(60) for t in range(rng.randrange(1, 6))]
    rows += [(100, 0, "assistant", None), (101, None, "user", "first"), (101, 0, "assistant", "second"), (102, 0, "user", "same"), (102, 0, "user", "same"), (None, 0, "assistant", "of no conversation")]
    assert run(spark, rows) == expected(rows)


def test_escapes_leave_no_control_string(spark):
    rows = spark.createDataFrame([(x,) for x in NASTY], "t string").select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect()
    for r in rows:
        assert r["u"] == r["t"]
        assert not any(c in r["e"] for c in ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


def test_typed_parts(spark):
    first = [("text", "see <", None, None), ("text", "|x", None, None), ("image", None, "a.png", 28.0 * 28 * 3), ("text", " and ", None, None), ("audio", None, "b.wav", 1.0), ("video", "skipped", None, 9.0), None]
    second = [("document", None, "c.pdf", 2.0), ("text", "done", None, None), ("image", None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", first), (1, 1, "assistant", second), (2, 0, "user", None)], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    rows = {r["conv_id"]: r for r in chat.format_chats(df).collect()}
    one = rows[1]
    assert one["formatted"] == "<|turn|>user<|body|>see <\\|x<|image:0|> and <|audio:1|><|end|>\n<|turn|>assistant<|body|><|document:2|>done<|image:3|><|end|>\n"
    assert [(a["turn"], a["number"], a["kind"], a["uri"], a["tokens"]) for a in one["attachments"]] == [(0, 0, "image", "a.png", 3), (0, 1, "audio", "b.wav", 25), (1, 2, "document", "c.pdf", 512), (1, 3, "image", None, 1)]
    assert one["attachment_tokens"] == 541
    spans = [one["formatted"][s["start"] : s["start"] + s["length"]] for s in one["loss_spans"]]
    assert spans == ["<|document:2|>done<|image:3|>"]
    assert rows[2]["formatted"] == "<|turn|>user<|body|><|end|>\n"


def test_empty(spark):
    df = spark.createDataFrame([], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    assert chat.read_back(chat.format_chats(df)).count() == 0


def test_long_conversation_with_attachments(spark):
    """Numbers and spans over 5,000 turns, in less than three times the time of texts alone."""
    import time

    seconds = {}
    for kind in ("text", "image"):
        part = f"array(named_struct('kind', 'text', 'text', concat('say <|', id), 'uri', cast(null AS string), 'units', cast(null AS double)), named_struct('kind', '{kind}', 'text', '', 'uri', concat('u', id), 'units', 784D))"
        df = spark.range(5000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", f"{part} AS parts")
        chat.format_chats(df.where("turn < 10")).collect()
        began = time.time()
        one = chat.format_chats(df).first()
        seconds[kind] = time.time() - began
        spans = [one["formatted"][s["start"] : s["start"] + s["length"]] for s in one["loss_spans"]]
        assert spans == [f"say <\\|{k}" + (f"<|image:{k}|>" if kind == "image" else "") for k in range(1, 5000, 2)]
        assert [(a["turn"], a["number"], a["uri"]) for a in one["attachments"]] == ([(k, k, f"u{k}") for k in range(5000)] if kind == "image" else [])
    assert seconds["image"] < 3 * seconds["text"] + 2
