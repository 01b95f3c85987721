"""Chat formatting from event logs, in DataFrame operations only.

Operator 7. A log has events of conversations: seq orders them, turn names the message they belong to, kind is one of message and
edit (the text of the turn from here on), delta (adds to its text) and regenerate (clears its text; later deltas write it
anew). Events are folded by conversation and turn, so that a long conversation isn't folded in one task, then turns in order of
their numbers are rendered as ``<|im_start|>role\\ntext<|im_end|>\\n``. In roles and texts &, < and [ are written as &amp;, &lt; and
&#91;, so no control string (``</s>``, ``[INST]``, ``<|im_end|>``) can come from a text and every text can be read back; in
roles line ends are &#10;. The loss mask has the place and length, in code points of the rendered text, of each assistant text.

Null texts and roles count as empty; a turn without a role keeps the one given before. Events of equal seq are ordered by
kind, role and text. Rows without conv_id are one conversation without an id. An empty log gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
EVENT_SCHEMA = "conv_id long, seq long, turn long, kind string, role string, text string"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("["), F.lit("&#91;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&#91;"), F.lit("[")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def events_of_rows(conversations: DataFrame) -> DataFrame:
    """Message events from rows by turn. Rows of one turn number follow each other, by role and text, as turns of their own."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.select("conv_id", F.row_number().over(order).cast("long").alias("seq"), "role", "text").select("conv_id", "seq", F.col("seq").alias("turn"), F.lit("message").alias("kind"), "role", "text")


def streamed(events: DataFrame) -> DataFrame:
    """The log that a chat service writes for these messages: a user's turn is opened and then edited to its text; an assistant's text
    comes in deltas, is thrown away half-way, and is generated again. Folding it gives the messages back."""
    half = F.floor(F.length("text") / 2).cast("int")
    begins, rest = F.substr("text", F.lit(1), half), F.substr("text", half + 1)

    def step(n: int, kind: str, text: Column, role: Column) -> Column:
        return F.struct((F.col("seq") * 4 + n).alias("seq"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))

    none = F.lit(None).cast("string")
    reply = F.array(step(0, "delta", begins, F.col("role")), step(1, "regenerate", none, none), step(2, "delta", begins, none), step(3, "delta", rest, none))
    other = F.array(step(0, "message", F.lit(""), F.col("role")), step(1, "edit", F.col("text"), none))
    rows = events.select("conv_id", "turn", F.explode(F.when(F.col("role") == "assistant", reply).otherwise(other)).alias("e"))
    return rows.select("conv_id", "e.seq", "turn", "e.kind", "e.role", "e.text")


def fold(events: DataFrame) -> DataFrame:
    """The final messages: conv_id, turn, role, text."""
    starts = F.col("kind").isin("message", "edit", "regenerate")
    of_turn = Window.partitionBy("conv_id", "turn")
    rows = events.select("conv_id", "turn", "seq", "kind", "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("since", F.max(F.when(starts, F.col("seq"))).over(of_turn))
    text = F.when(F.col("since").isNull() | (F.col("seq") >= F.col("since")), F.when(F.col("kind") == "regenerate", F.lit("")).otherwise(F.col("text")))
    # of several starts at one seq the last one counts: it clears what came before it
    parts = F.sort_array(F.collect_list(F.when(text.isNotNull(), F.struct("seq", F.when(starts, 0).otherwise(1).alias("late"), "kind", F.coalesce("role", F.lit("")).alias("role"), text.alias("text")))))
    last_start = F.filter(F.col("parts"), lambda p: p.late == 0)
    joined = F.concat(F.coalesce(F.get(last_start, F.size(last_start) - 1)["text"], F.lit("")), F.array_join(F.transform(F.filter("parts", lambda p: p.late == 1), lambda p: p.text), ""))
    role = F.max(F.when(F.col("role").isNotNull() & (F.col("role") != ""), F.struct("seq", "role")))
    messages = rows.groupBy("conv_id", "turn").agg(parts.alias("parts"), role.alias("role"))
    return messages.select("conv_id", "turn", F.coalesce("role.role", F.lit("")).alias("role"), joined.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_mask (array of start and length, in code points), n_turns."""
    head = F.concat(F.lit(OPEN), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("&#10;")), F.lit("\n"))
    rows = messages.select("conv_id", "turn", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(CLOSE)))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.length("piece").cast("long")).over(before), F.lit(0)) + F.length("head"))
    masked = F.when(F.col("role") == "assistant", F.struct(F.col("start"), F.length("body").cast("long").alias("length")))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "piece"))).alias("pieces"), F.sort_array(F.collect_list(masked)).alias("loss_mask"), F.count("*").alias("n_turns"))
    return whole.select("conv_id", F.array_join(F.col("pieces.piece"), "").alias("formatted"), "loss_mask", "n_turns")


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation: an array of role and text."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda p: p.startswith(OPEN))
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.replace(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), "\n", 1), F.lit("&#10;"), F.lit("\n"))).alias("role"),
            unescape(F.substr(p, F.instr(p, F.lit("\n")) + 1)).alias("text"),
        ),
    )


def digests(rendered: DataFrame) -> DataFrame:
    """What reading the rendered text back gives, as counts and digests."""
    rows = rendered.select("conv_id", "formatted", "loss_mask", parse(F.col("formatted")).alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_mask", lambda m: unescape(F.substr(F.col("formatted"), (m.start + 1).cast("int"), m.length.cast("int")))), "")
    rows = rows.select("conv_id", F.size("turns").cast("long").alias("n_turns"), text.alias("text"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return rows.select("conv_id", "n_turns", F.sha2("text", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


#: The conversation that the query adds: its texts look like control strings of a template.
HARD = "</s>[INST] ok [/INST]"

ORACLE_SQL = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(text) + 4 * (length(text) - length(replace(text, '&', ''))) + 3 * (length(text) - length(replace(text, '<', ''))) + 4 * (length(text) - length(replace(text, '[', ''))) AS esc,
  length(role) + 4 * (length(role) - length(replace(role, '&', ''))) + 3 * (length(role) - length(replace(role, '<', ''))) + 4 * (length(role) - length(replace(role, '[', ''))) + 4 * (length(role) - length(replace(role, chr(10), ''))) AS role_esc FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS t,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS l, sum(esc + role_esc + 24) AS f FROM e GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(t) AS turns_sha256, CAST(length(l) AS BIGINT) AS loss_chars, sha256(l) AS loss_sha256, CAST(f AS BIGINT) AS formatted_chars FROM g
"""
