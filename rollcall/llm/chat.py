r"""Chat formatting by event-sourced reconstruction.

A log holds one event a row: ``conv_id``, ``seq``, ``kind``, ``message_id``,
``role``, ``text``. Kinds:

* ``message``    the whole text of a message (replaces what it had)
* ``delta``      text streamed onto the end of a message
* ``edit``       a new text for a message; streaming may go on behind it
* ``regenerate`` empties a message and drops each later message that began before
* ``delete``     removes the message, unless later events rebuild it

The log is grouped by (conversation, message), each message's events are sorted
by sequence and folded from its last reset on; a window drops what a
regeneration has cut off; messages are then gathered by conversation in order of
their first event and rendered, with their places as a running sum, so the work
is proportional to the conversation. All of it is DataFrame work. A long
conversation's messages are folded in many tasks; only its rendering, which is
one output value, meets in one.

Template: ``<|im_start|>role<|im_sep|>text<|im_end|>\n``. Control strings inside
roles and texts get a backslash behind their first character and backslashes are
doubled, so none survives inside a text and unescaping gives every text back.

Defined results: null text and role are empty; a null conv_id is a conversation
of its own; a message's events tied on sequence are ordered by kind and text, and
messages that begin together by role, text and then id; rows repeated as messages
(distinct ids) are all kept; texts of any length are kept whole (one rendered
conversation is one value, so 2 GB at most); an empty log gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import table

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
#: Strings that common chat templates give a meaning.
CONTROL = ["<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]


def escape(col):
    out = F.replace(col, F.lit("\\"), F.lit("\\\\"))
    for s in CONTROL:
        out = F.replace(out, F.lit(s), F.lit(s[0] + "\\" + s[1:]))
    return out


def unescape(col):
    r"""Pairs of backslashes become one; a lone backslash goes."""
    return F.regexp_replace(col, r"\\(\\?)", "$1")


def fold(events: DataFrame) -> DataFrame:
    """The final messages: conv_id, ord, role, text."""
    seq = F.struct("seq", "message_id", "kind", F.coalesce("text", F.lit("")).alias("text"))
    resets = F.col("kind").isin("message", "edit", "regenerate", "delete")
    per = events.groupBy("conv_id", "message_id").agg(
        F.min("seq").alias("first"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("regenerated"),
        F.max(F.when(resets, F.struct("seq", "kind"))).alias("reset"),
        F.max_by("role", F.when(F.col("role").isNotNull(), F.struct("seq", "role"))).alias("role"),
        F.array_sort(F.collect_list(seq)).alias("log"),
    )
    live = F.filter("log", lambda e: F.col("reset").isNull() | (e["seq"] > F.col("reset.seq")) | ((e["seq"] == F.col("reset.seq")) & (e["kind"] == F.col("reset.kind"))))
    text = F.array_join(F.transform(F.filter(live, lambda e: ~e["kind"].isin("regenerate", "delete")), lambda e: e["text"]), "")
    before = W.partitionBy("conv_id").orderBy("first", "message_id").rowsBetween(W.unboundedPreceding, -1)
    return (
        per.withColumn("text", text)
        .withColumn("cut", F.max("regenerated").over(before))
        .withColumn("role", F.coalesce("role", F.lit("")))
        .where("(cut is null or first > cut) and not (reset.kind <=> 'delete' and text = '')")
        .select("conv_id", F.struct("first", "role", "text", "message_id").alias("ord"), "role", "text")
    )


def render(messages: DataFrame) -> DataFrame:
    """One row a conversation: n_turns, formatted, and loss_mask as spans of code points."""
    learn, turn, size = F.col("role") == "assistant", F.concat(F.lit(START), escape("role"), F.lit(SEP), escape("text"), F.lit(END)), F.length(escape("text"))
    turns = messages.select("conv_id", "ord", learn.alias("learn"), turn.alias("turn"), size.alias("size"))
    stop = F.sum(F.length("turn")).over(W.partitionBy("conv_id").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)) - len(END)
    placed = turns.withColumn("stop", stop).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("stop", "learn", "turn", "size"))).alias("t"))
    mask = F.transform(F.filter("t", lambda x: x["learn"]), lambda x: F.struct((x["stop"] - x["size"]).alias("start"), x["stop"].alias("stop")))
    return placed.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.array_join(F.transform("t", lambda x: x["turn"]), "").alias("formatted"), mask.alias("loss_mask"))


def read_back(chats: DataFrame) -> DataFrame:
    """The turns and the text under the loss mask, from ``formatted`` and ``loss_mask`` alone."""
    pieces = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda x: x != "")
    turn = lambda x: F.struct(unescape(F.substring_index(F.substring(x, len(START) + 1, 2**31 - 1), SEP, 1)).alias("role"), unescape(F.substring_index(x, SEP, -1)).alias("text"))
    loss = F.transform("loss_mask", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int"))))
    return chats.withColumn("turns", F.transform(pieces, turn)).withColumn("loss_text", F.array_join(loss, ""))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, whose texts are control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = rows.unionByName(planted)
    # each row is a message of its own, named by its place; what is tied on the turn goes by role and text
    events = rows.select(
        "conv_id",
        F.coalesce("turn", F.lit(-(2**62))).alias("seq"),
        F.lit("message").alias("kind"),
        F.monotonically_increasing_id().alias("message_id"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    back = read_back(render(fold(events)))
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(lines, "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss_text", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_escape(col: str) -> str:
    out = rf"replace({col}, '\', '\\')"
    for s in CONTROL:
        out = f"replace({out}, '{s}', '{s[0]}\\{s[1:]}')"
    return out


OP3_SQL = f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) v
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum({len(START) + len(SEP) + len(END)} + length({_sql_escape("role")}) + length({_sql_escape("text")})) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""
