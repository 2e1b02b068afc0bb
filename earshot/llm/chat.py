"""Chat formatting of typed content parts, in DataFrame functions only.

A message is a role and an array of parts (:data:`PART`): text, image, audio or document. A visitor over the parts turns
each into its piece of the message body: text is escaped, any other part becomes a placeholder ``<|kind:n|>`` that is
numbered over the conversation, and its reference and expanded token count are recorded as an attachment.

A turn is ``<|im_start|>role``, a newline, the body, ``<|im_end|>`` and a newline. Control strings inside texts are made
harmless by a word joiner after their first character; a text that holds such a broken string already gets one more, so
unescaping (one less) gives every text back. Neighbouring text parts are joined before they are escaped, so no control
string can be put together over an edge; a placeholder starts and ends a text, as its own signs cannot continue one. In
roles, backslashes and newlines are escaped, and control strings like those in texts.

The loss mask is a list of byte ranges of the formatted text, ``<|im_end|>`` excluded: one for each trained turn.

Edge cases: a null text or role is empty; a message without parts has an empty body; a part of unknown kind is a
placeholder of its kind with its own token count, or none; turns of equal number are ordered by role, then body;
repeated rows are repeated turns; rows without a conversation id make one conversation; an empty table gives an empty
result; further columns are ignored. One conversation is one output row, so its turns meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int,tokens:long>"

# The control strings of the template and those of other common templates.
START, END = "<|im_start|>", "<|im_end|>"
JOINER = "\u2060"
_CONTROL = r"(\||/?s>|/?INST\]|</?SYS>>)"
_ESCAPE = r"([<\[])(\x{2060}*)" + _CONTROL
_UNESCAPE = r"([<\[])\x{2060}(\x{2060}*)" + _CONTROL

#: Tokens that a part expands to: pixels of an image patch's side, tokens per second of sound, tokens per page.
PATCH, PER_SECOND, PER_PAGE = 28, 25, 800


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _ESCAPE, "$1$2" + JOINER + "$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2$3")


def _escaped_role(role: Column) -> Column:
    return F.replace(F.replace(escaped(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _unescaped_role(role: Column) -> Column:
    """Undo the escapes left to right: halves of double backslashes are kept apart from the newline escape."""
    halves = F.split(role, r"\\\\", -1)
    return unescaped(F.array_join(F.transform(halves, lambda h: F.replace(h, F.lit("\\n"), F.lit("\n"))), "\\"))


def expanded_tokens(part: Column) -> Column:
    """Tokens that a part other than text takes: as given, else by its size."""
    image = F.ceil(part["width"] / PATCH) * F.ceil(part["height"] / PATCH)
    sized = (F.when(part["type"] == "image", image).when(part["type"] == "audio", F.ceil(part["seconds"] * PER_SECOND))
             .when(part["type"] == "document", part["pages"] * PER_PAGE))
    return F.coalesce(part["tokens"], sized, F.lit(0)).cast("long")


def text_part(text: Column) -> Column:
    """One text part as an array of parts."""
    nulls = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int", "tokens": "long"}
    return F.array(F.struct(F.lit("text").alias("type"), text.cast("string").alias("text"),
                            *(F.lit(None).cast(kind).alias(name) for name, kind in nulls.items())))


def _is_text(part: Column) -> Column:
    return F.coalesce(part["type"] == "text", F.lit(False))


def flattened(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, pieces, attachments): what the visitor makes of each message's parts, in order.

    ``pieces``: the escaped text, or the kind of a placeholder. The first of neighbouring texts holds all of them, the others
    are empty, so pieces keep the places of their parts. ``attachments``: the place, kind, reference and expanded tokens of
    each part that is no text.
    """
    parts = F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>"))
    kind = lambda p: F.regexp_replace(F.coalesce(p["type"], F.lit("none")), r"[|<>\n]", "")
    is_text, said = F.transform(parts, _is_text), F.transform(parts, lambda p: F.coalesce(p["text"], F.lit("")))

    def run_from(i: Column) -> Column:
        """The texts from part ``i`` up to the next part that is none."""
        upto = F.array_position(F.slice(is_text, i + 1, F.size(parts)), False)
        return F.array_join(F.slice(said, i + 1, F.when(upto > 0, upto - 1).otherwise(F.size(parts)).cast("int")), "")
    starts = lambda i: (i == 0) | ~F.coalesce(F.get(is_text, i - 1), F.lit(False))
    pieces = F.transform(parts, lambda p, i: F.struct(
        F.when(_is_text(p), F.when(starts(i), escaped(run_from(i))).otherwise("")).alias("text"), F.when(~_is_text(p), kind(p)).alias("kind")))
    others = F.filter(F.transform(parts, lambda p, i: F.when(~_is_text(p), F.struct(
        F.col("turn").cast("long").alias("turn"), i.alias("part"), p["type"].alias("type"), p["ref"].alias("ref"),
        expanded_tokens(p).alias("tokens")))), lambda x: x.isNotNull())
    return messages.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                           pieces.alias("pieces"), others.alias("attachments"))


def _body(before: Column) -> Column:
    """Texts as they are, placeholders numbered on from those of the turns before."""
    at = F.transform("attachments", lambda a: a["part"])
    return F.array_join(F.transform("pieces", lambda p, i: F.coalesce(p["text"], F.concat(
        F.lit("<|"), p["kind"], F.lit(":"), (before + F.array_position(at, i)).cast("string"), F.lit("|>")))), "")


def formatted(messages: DataFrame, trained_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss (array of byte ranges from, to), attachments, expanded_tokens.

    ``messages``: conv_id, turn, role, parts. Running counts of placeholders and bytes come from windows over the turns;
    they and the final gathering share one shuffle and one sort.
    """
    turns = Window.partitionBy("conv_id").orderBy("turn", "role", "pieces")
    before = turns.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    rows = flattened(messages).withColumns({
        "nth": F.row_number().over(turns), "earlier": F.coalesce(F.sum(F.size("attachments")).over(before), zero)})
    rows = rows.withColumns({"head": F.concat(F.lit(START), _escaped_role(F.col("role")), F.lit("\n")), "body": _body(F.col("earlier"))})
    tail = END + "\n"
    rows = rows.withColumn("size", (F.octet_length("head") + F.octet_length("body") + len(tail)).cast("long"))
    rows = rows.withColumn("from", F.coalesce(F.sum("size").over(before), zero) + F.octet_length("head"))
    span = F.when(F.col("role").isin(*trained_roles), F.struct("from", (F.col("from") + F.octet_length("body")).alias("to")))
    told = F.struct("nth", F.concat("head", "body", F.lit(tail)).alias("said"), span.alias("span"), "attachments")
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(told)).alias("turns"))
    attachments = F.flatten(F.transform("turns", lambda t: t["attachments"]))
    return chats.select(
        "conv_id", F.array_join(F.transform("turns", lambda t: t["said"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss"), attachments.alias("attachments"),
        F.aggregate(F.transform(attachments, lambda a: a["tokens"]), zero, lambda x, y: x + y).alias("expanded_tokens"))


def parsed(chats: DataFrame) -> DataFrame:
    """``chats`` with turns (array of role, text) and loss_texts read back from ``formatted`` and ``loss``."""
    blocks = F.split("formatted", r"<\|im_end\|>\n", -1)
    turns = F.transform(F.slice(blocks, 1, F.size(blocks) - 1), lambda b: F.struct(
        _unescaped_role(F.substring_index(F.substr(b, F.lit(len(START) + 1)), "\n", 1)).alias("role"),
        unescaped(F.substr(b, F.instr(b, "\n") + 1)).alias("text")))
    data = F.col("formatted").cast("binary")
    # Ranges of a binary are cut without walking the text.
    texts = F.transform("loss", lambda s: unescaped(F.substr(data, (s["from"] + 1).cast("int"), (s["to"] - s["from"]).cast("int")).cast("string")))
    return chats.withColumns({"turns": turns, "loss_texts": texts})


def chat_report(conversations: DataFrame) -> DataFrame:
    """The digest columns of query op6, read back from the formatted conversations and conversation -7."""
    spark = conversations.sparkSession
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(more)
    read = parsed(formatted(rows.select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts"))))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
                       F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


ORACLE_SQL = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), told as (
  select *, regexp_replace(text, '([<\[])(\x{2060}*)(\||/?s>|/?INST\]|</?SYS>>)', '\1\2' || chr(8288) || '\3', 'g') as body,
         replace(replace(regexp_replace(role, '([<\[])(\x{2060}*)(\||/?s>|/?INST\]|</?SYS>>)', '\1\2' || chr(8288) || '\3', 'g'),
                         '\', '\\'), chr(10), '\n') as head
  from rows
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, body)) as turns_sha256,
       coalesce(cast(sum(length(text)) filter (role = 'assistant') as bigint), 0) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, body) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(12 + length(head) + 1 + length(body) + 11) as bigint) as formatted_chars
from told group by conv_id
"""
