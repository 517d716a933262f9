"""Chat formatting: typed content parts flattened into one string, with attachments and a loss mask. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Marks of the template, and the character that breaks up control strings inside texts.
TURN, BODY, END, ESCAPE = "<|turn|>", "<|body|>", "<|end|>", "␛"
#: What a control string may go on with after its first character: of this template and of common others (fixed values).
CONTROL = r"([<\[])(?=\||/?s>|</?SYS>>|/?INST\])"
#: Placeholders of attachments, and how many tokens they stand for.
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
IMAGE_PATCH, AUDIO_TOKENS_A_SECOND, DOCUMENT_TOKENS_A_PAGE = 28, 25, 512

PARTS = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


def escape(text: Column) -> Column:
    """A text in which no control string is left: the escape character is doubled, and put behind each control string's first character."""
    return F.regexp_replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2)), CONTROL, f"$1{ESCAPE}")


def unescape(text: Column) -> Column:
    """The text that :func:`escape` was given."""
    return F.regexp_replace(text, f"{ESCAPE}({ESCAPE}?)", "$1")


def _flatten(part: Column) -> Column:
    """The visitor's step: what a part stands as in the output. Parts of unknown kind stand as their text."""
    out = escape(F.coalesce(part["text"], F.lit("")))
    for kind, mark in PLACEHOLDERS.items():
        out = F.when(part["kind"] == kind, F.lit(mark)).otherwise(out)
    return out


def _expanded(part: Column) -> Column:
    """Tokens that an attachment's placeholder is expanded to."""
    cells = lambda c: F.ceil(F.coalesce(part[c], F.lit(0)) / F.lit(IMAGE_PATCH))
    return (
        F.when(part["kind"] == "image", cells("width") * cells("height"))
        .when(part["kind"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_TOKENS_A_SECOND))
        .when(part["kind"] == "document", F.coalesce(part["pages"], F.lit(0)) * DOCUMENT_TOKENS_A_PAGE)
        .cast("long")
    )


def format_chats(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation of ``messages`` (conv_id, turn, role, parts): conv_id, n_turns, formatted, loss_spans, attachments, expanded_tokens.

    A turn stands as its role and its parts between the template's marks; loss_spans are the places
    (start, length, in code points from 0) that are trained on: the texts of ``loss_roles``. A span also names its
    turn, from 0, and its offset in that turn's piece, so that reading it costs a turn, not the whole string.
    attachments lists ordinal, turn, kind, ref and expanded tokens of each placeholder in order.

    Offsets are a running sum over a conversation's turns; only then are its turns gathered, as the
    conversation's string needs them all in one row. That row is the conversation itself, so it
    grows with the longest conversation, not with the table.

    Edge cases: null role, text or parts are empty; turns are ordered by turn, nulls first, and
    equal ones by role and text; repeated rows stay. Rows with a null conv_id form one conversation
    of their own. Extra columns are ignored; an empty table gives no rows.
    """
    parts = F.coalesce(F.col("parts").cast(PARTS), F.array().cast(PARTS))
    turns = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), parts.alias("parts"))
    turns = turns.withColumn("head", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY))).withColumn("body", F.array_join(F.transform("parts", _flatten), ""))
    turns = turns.withColumn("piece", F.concat("head", "body", F.lit(END)))
    attached = F.filter("parts", lambda p: p["kind"].isin(*PLACEHOLDERS))
    turns = turns.withColumn("attached", F.transform(attached, lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), _expanded(p).alias("tokens"))))
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("body")]
    w = Window.partitionBy("conv_id").orderBy(*order)
    before = lambda c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = turns.withColumn("at", before(F.length("piece"))).withColumn("seen", before(F.size("attached"))).withColumn("n", F.row_number().over(w))
    row = F.struct(
        "n",
        "piece",
        F.struct((F.col("at") + F.length("head")).alias("start"), F.length("body").cast("long").alias("length"), (F.col("n") - 1).cast("int").alias("turn"), F.length("head").alias("offset")).alias("span"),
        F.col("role").isin(*loss_roles).alias("trained"),
        F.transform("attached", lambda a, i: F.struct((F.col("seen") + i).alias("ordinal"), F.col("turn").alias("turn"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))).alias("attached"),
    )
    chats = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("t"))
    listed = F.flatten(F.transform("t", lambda x: x["attached"]))
    return chats.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"),
        F.transform(F.filter("t", lambda x: x["trained"]), lambda x: x["span"]).alias("loss_spans"),
        listed.alias("attachments"),
        F.aggregate(listed, F.lit(0).cast("long"), lambda s, a: s + a["tokens"]).alias("expanded_tokens"),
    )


def read_back(chats: DataFrame) -> DataFrame:
    """Turns and masked text of :func:`format_chats`, read from ``formatted`` and ``loss_spans`` alone: arrays turns (role, text) and loss.

    The string is cut at its ends of turns once; a span is then cut out of its turn's piece, in time linear in the string.
    """
    pieces = F.split("formatted", r"<\|end\|>")
    bound = lambda f: F.get(F.transform(F.array(pieces), f), 0)  # noqa: E731  the pieces are cut once, not once a span
    part = lambda p, i: unescape(F.regexp_extract(p, r"(?s)^<\|turn\|>(.*?)<\|body\|>(.*)$", i))
    turns = F.transform(bound(lambda p: F.slice(p, 1, F.size(p) - 1)), lambda p: F.struct(part(p, 1).alias("role"), part(p, 2).alias("text")))
    loss = bound(lambda p: F.transform("loss_spans", lambda s: unescape(F.substring(F.get(p, s["turn"]), s["offset"] + 1, s["length"].cast("int")))))
    return chats.withColumn("turns", turns).withColumn("loss", loss)


def text_messages(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, parts) from rows of plain text: one text part each."""
    typed = F.array(F.struct(F.lit("text").alias("kind"), F.coalesce("text", F.lit("")).alias("text"), *(F.lit(None).cast(t).alias(c) for c, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int")))))
    return conversations.select("conv_id", "turn", "role", typed.alias("parts"))


def chat_digests(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """Digests of all conversations, and of number -1 whose texts hold control strings, as read back from the formatted output."""
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")
    )
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(probe)
    chats = read_back(format_chats(text_messages(rows)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ESCAPED = "regexp_replace(replace({0}, '␛', '␛␛'), '(<)(\\||/s>|s>|<SYS>>|</SYS>>)|(\\[)(INST\\]|/INST\\])', '\\1\\3␛\\2\\4', 'g')"
ORACLE = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(TURN + BODY + END)} + length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')}))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""
