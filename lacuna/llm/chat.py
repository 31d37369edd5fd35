"""Chat formatting of messages with typed content parts, by DataFrame functions alone.

A message holds an array of parts ``struct<kind string, text string, uri string, units double>``.
:func:`flatten` visits the parts in order: a text part gives its text with control strings escaped, an
image, audio or document part gives one placeholder and an attachment (conv_id, turn, its number in the
conversation, kind, uri, tokens). ``units`` are an image's pixels, an audio's seconds, a document's
pages; the tokens that a placeholder expands to follow from them by ``TOKENS``.

The template writes a turn as ``<|turn|>ROLE<|body|>TEXT<|end|>`` and a newline. A control string
(``CONTROL``) inside a role or text gets a backslash after its first character, and one that already
has backslashes there gets one more, so that unescaping restores every text exactly. Assistant bodies
are under the loss mask, kept as (start, length) spans in code points of the formatted string.

Turns are ordered by turn (null first), then role, then text, so that repeated rows are turns like
others and reruns agree. Null roles and texts are empty; unknown kinds and null parts are skipped; a
null array of parts is an empty text. Rows of a null conv_id make one conversation. A conversation is
one output row by definition, so its turns meet in one task. Extra columns of
the input aren't read; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What may follow ``<`` or ``[`` to make a control string of this or other common templates.
CONTROL = ("|", "s>", "/s>", "<SYS>>", "</SYS>>", "INST]", "/INST]")
_FOLLOW = "(?=" + "|".join("\\" + c if c == "|" else c.replace("]", "\\]") for c in CONTROL) + ")"
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>\n"
PARTS = "array<struct<kind:string,text:string,uri:string,units:double>>"
#: kind: units a token, tokens at least
TOKENS = {"image": (28.0 * 28.0, 1), "audio": (0.04, 1), "document": (1.0 / 256.0, 1)}


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _FOLLOW, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _FOLLOW, "$1$2")


def part_tokens(part: Column) -> Column:
    """Tokens that an attachment's placeholder expands to; of unknown extent: the least."""
    out = F.lit(None).cast("long")
    for kind, (unit, least) in TOKENS.items():
        out = F.when(part["kind"] == kind, F.greatest(F.ceil(F.coalesce(part["units"], F.lit(0.0)) / unit), F.lit(least)).cast("long")).otherwise(out)
    return out


def text_part(text: Column) -> Column:
    nothing = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), nothing.cast("string").alias("uri"), nothing.cast("double").alias("units")))


def _is_attachment(part: Column) -> Column:
    return part["kind"].isin(*TOKENS)


def _known(parts: Column) -> Column:
    return F.filter(F.coalesce(parts, F.array().cast(PARTS)), lambda p: p["kind"].isNotNull() & (_is_attachment(p) | (p["kind"] == "text")))


def flatten(parts: Column, first: Column) -> tuple[Column, Column]:
    """A turn's body (escaped text and placeholders) and its attachments, numbered from ``first`` on."""
    parts = _known(parts)
    nothing = F.struct(F.lit("").alias("text"), F.lit("").alias("raw"), first.cast("int").alias("n"))  # raw: neighbouring texts, which are escaped as one
    text = lambda a, p: F.struct(a["text"].alias("text"), F.concat(a["raw"], F.coalesce(p["text"], F.lit(""))).alias("raw"), a["n"].alias("n"))
    other = lambda a, p: F.struct(F.concat(a["text"], escape(a["raw"]), F.lit("<|"), p["kind"], F.lit(":"), a["n"].cast("string"), F.lit("|>")).alias("text"), F.lit("").alias("raw"), (a["n"] + 1).alias("n"))
    body = F.aggregate(parts, nothing, lambda a, p: F.when(p["kind"] == "text", text(a, p)).otherwise(other(a, p)), lambda a: F.concat(a["text"], escape(a["raw"])))
    notes = F.transform(F.filter(parts, _is_attachment), lambda p, k: F.struct((first + k).cast("int").alias("number"), p["kind"].alias("kind"), p["uri"].alias("uri"), part_tokens(p).alias("tokens")))
    return body, notes


def format_chats(messages: DataFrame) -> DataFrame:
    """``messages`` (conv_id, turn, role, parts) to conv_id, formatted, loss_spans, attachments, tokens of attachments.

    Numbers of attachments and places of spans are running sums over a conversation's turns, so the work
    is linear in them; the rows are grouped where they are already."""
    turns = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.col("parts").cast(PARTS).alias("parts"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "parts")
    before = lambda c: F.coalesce(F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    placed = turns.withColumns({"at": F.row_number().over(order), "first": before(F.size(F.filter(_known(F.col("parts")), _is_attachment)))})
    body, notes = flatten(F.col("parts"), F.col("first"))
    pieces = placed.select("conv_id", "turn", "role", "parts", "at", body.alias("body"), notes.alias("notes"))
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY))
    pieces = pieces.select("conv_id", "turn", "role", "at", "notes", F.concat(head, "body", F.lit(END)).alias("piece"), F.length(head).alias("head"), F.length("body").alias("length"))
    by_place = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.col("head") + F.col("length") + len(END)).over(by_place), F.lit(0)) + F.col("head")
    notes = F.transform("notes", lambda a: F.struct(F.col("turn").alias("turn"), a["number"].alias("number"), a["kind"].alias("kind"), a["uri"].alias("uri"), a["tokens"].alias("tokens")))
    rows = pieces.select("conv_id", F.struct("at", "piece", F.when(F.col("role") == "assistant", F.struct(begin.cast("int").alias("start"), "length")).alias("span"), notes.alias("notes")).alias("row"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    attachments = F.flatten("rows.notes")
    return grouped.select("conv_id", F.array_join("rows.piece", "").alias("formatted"), F.array_compact("rows.span").alias("loss_spans"), attachments.alias("attachments"), F.aggregate(attachments["tokens"], F.lit(0).cast("long"), lambda a, x: a + x).alias("attachment_tokens"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text; placeholders stay), loss (unescaped texts under the mask), from formatted strings alone."""
    pieces = F.filter(F.split("formatted", r"<\|end\|>\n"), lambda x: x != "")
    turn = lambda x: F.struct(
        unescape(F.substring_index(F.substring(x, len(TURN) + 1, 1 << 30), BODY, 1)).alias("role"),
        unescape(F.substring_index(x, BODY, -1)).alias("text"),
    )
    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return formatted.select("conv_id", F.transform(pieces, turn).alias("turns"), loss.alias("loss"), F.length("formatted").alias("formatted_chars"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    more = spark.sql("SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    back = read_back(format_chats(rows.unionByName(more).select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts"))))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(F.array_join("loss", "")).cast("long").alias("loss_chars"),
        F.sha2(F.array_join("loss", ""), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long"),
    )


OP4_SQL = r"""
WITH rows AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), counted AS (
  SELECT *, len(regexp_extract_all(text, '[<\[]\\*(\||s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\])'))
          + len(regexp_extract_all(role, '[<\[]\\*(\||s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\])')) AS escapes FROM rows
)
SELECT conv_id, COUNT(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  SUM(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(COALESCE(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  SUM(length(role) + length(text) + escapes + 24)::BIGINT AS formatted_chars
FROM counted GROUP BY conv_id
"""
