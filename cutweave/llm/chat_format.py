"""Chat formatting with DataFrame functions only: typed content parts become text and ordered placeholders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BEGIN, END = "<|im_start|>", "<|im_end|>\n"
PART = "struct<type:string,text:string,uri:string,width:long,height:long,seconds:double,pages:long>"
#: Tokens that a placeholder expands to: an image's 14-pixel patches, an audio's 25 frames a second, a document's 512 a page.
PATCH, FRAMES, PAGE_TOKENS, IMAGE_DEFAULT = 14, 25, 512, 256
LOSS_ROLES = ("assistant",)


def escape(c: Column) -> Column:
    """Reversible: no control string begins in what it gives, as each <| becomes <\\|; a backslash is doubled."""
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"\\([\\|])", "$1")


def escape_role(c: Column) -> Column:
    """As escape; a line feed, which ends a role, becomes a backslash and n."""
    return F.replace(escape(c), F.lit("\n"), F.lit("\\n"))


def unescape_role(c: Column) -> Column:
    # a doubled backslash is set aside first, so that what follows it isn't read as an escape
    return F.array_join(F.transform(F.split(c, r"\\\\", -1), lambda x: F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\|"), F.lit("|"))), "\\")


def _kind(p: Column) -> Column:
    return F.when(p["type"].isNull() | (p["type"] == "text"), "text").when(p["type"].isin("image", "audio", "document"), p["type"]).otherwise("unknown")


def _tokens(p: Column) -> Column:
    image = F.coalesce(F.ceil(p["width"] / PATCH) * F.ceil(p["height"] / PATCH), F.lit(IMAGE_DEFAULT).cast("long"))
    k = _kind(p)
    return F.when(k == "image", image).when(k == "audio", F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * FRAMES)).when(k == "document", F.coalesce(p["pages"], F.lit(1)) * PAGE_TOKENS).otherwise(F.lit(0)).cast("long")


def _visit(p: Column, i: Column) -> Column:
    """What a part leaves in the output: its escaped text, or a placeholder of its kind. A bar that begins a later part is
    escaped as well, lest it meet the end of the part before in a control string."""
    text = escape(F.coalesce(p["text"], F.lit("")))
    text = F.when((i > 0) & text.startswith("|"), F.concat(F.lit("\\"), text)).otherwise(text)
    return F.when(_kind(p) == "text", text).otherwise(F.concat(F.lit("<|"), _kind(p), F.lit("|>")))


def format_chats(messages: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_spans (array of start and length, in code points of
    formatted), attachments (array of ordinal, turn, part, type, uri, tokens) and attachment_tokens.

    ``messages``: conv_id, turn, role, parts (array of PART). Turns go by turn, ties by role, then content; repeated
    rows are repeated turns. Null role or text is empty; null parts are no parts; a part of an unknown type becomes
    <|unknown|> with no tokens; rows with a null conv_id are one conversation. An empty table gives no rows; other
    columns are ignored. The loss covers the content of assistant turns, neither their role nor their end mark. Windows
    and the grouping share one shuffle, on conv_id: a conversation, very long texts included, is one row of the result
    and so one task's work, whatever its size.
    """
    parts = F.coalesce(F.col("parts").cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>"))
    turns = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), parts.alias("parts"))
    turns = turns.withColumn("content", F.array_join(F.transform("parts", _visit), ""))
    turns = turns.withColumn("head", F.concat(F.lit(BEGIN), escape_role(F.col("role")), F.lit("\n")))
    turns = turns.withColumn("segment", F.concat("head", "content", F.lit(END)))
    by = W.partitionBy("conv_id").orderBy("turn", "role", "content", F.to_json("parts"))
    turns = turns.withColumn("pos", F.row_number().over(by)).withColumn("at", F.coalesce(F.sum(F.length("segment")).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    media = F.filter(F.transform("parts", lambda p, i: F.struct(i.alias("part"), _kind(p).alias("type"), p["uri"].alias("uri"), _tokens(p).alias("tokens"))), lambda a: a["type"] != "text")
    turns = turns.withColumn("media", media)
    row = F.struct("pos", "segment", F.col("role").isin(*LOSS_ROLES).alias("loss"), (F.col("at") + F.length("head")).alias("start"), F.length("content").cast("long").alias("length"), "media", "turn")
    chats = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    placed = F.flatten(F.transform("rows", lambda r: F.transform(r["media"], lambda a: F.struct(r["turn"].alias("turn"), a["part"].alias("part"), a["type"].alias("type"), a["uri"].alias("uri"), a["tokens"].alias("tokens")))))
    attachments = F.transform(placed, lambda a, i: F.struct((i + 1).alias("ordinal"), a["turn"].alias("turn"), a["part"].alias("part"), a["type"].alias("type"), a["uri"].alias("uri"), a["tokens"].alias("tokens")))
    return chats.select(
        "conv_id",
        F.size("rows").cast("long").alias("n_turns"),
        F.array_join(F.transform("rows", lambda r: r["segment"]), "").alias("formatted"),
        F.transform(F.filter("rows", lambda r: r["loss"]), lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"))).alias("loss_spans"),
        attachments.alias("attachments"),
    ).withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"]))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted chat, as an array of role and text: what format_chats wrote, unescaped."""
    segments = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda s: s != "")
    line = lambda s: F.instr(s, "\n")
    return F.transform(segments, lambda s: F.struct(unescape_role(F.substring(s, F.lit(len(BEGIN) + 1), line(s) - len(BEGIN) - 1)).alias("role"), unescape(F.substring(s, line(s) + 1, F.length(s))).alias("text")))


def chat_digest(chats: DataFrame) -> DataFrame:
    """Digest columns, read back from the formatted text and the loss spans over it."""
    out = chats.withColumn("turns", read_turns(F.col("formatted")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    out = out.withColumn("loss", loss)
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def text_messages(conversations: DataFrame) -> DataFrame:
    """Rows of conv_id, turn, role, text as messages of one text part each."""
    part = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"), *(F.lit(None).cast(k).alias(n) for n, k in (("uri", "string"), ("width", "long"), ("height", "long"), ("seconds", "double"), ("pages", "long"))))
    return conversations.select("conv_id", "turn", "role", F.array(part).alias("parts"))
