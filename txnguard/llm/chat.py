"""Chat formatting as a grammar round trip, in SQL functions only.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn.  A deterministic
parser splits the output at ``<|im_start|>``, takes the role up to the first
line feed and the text up to ``<|im_end|>``, and unescapes both.  Each turn is
rendered as it is, reparsed and compared; only if the parse differs its control
strings are escaped (``<~...|im_end|>``: one tilde more than in the text; in
roles backslash and line feed), which the parser undoes.  The whole
conversation is then reparsed and compared once more; a difference is an error.

Defined cases: null and empty texts give empty texts, null roles empty roles,
a null turn comes first; turns with equal numbers are ordered by role and
text, repeated rows stay; a null conv_id is a conversation of its own; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_RAISE, _LOWER = (r"<(~*)\|(im_start|im_end)\|>", r"<~$1|$2|>"), (r"<~(~*)\|(im_start|im_end)\|>", r"<$1|$2|>")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_RAISE[0]), F.lit(_RAISE[1]))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_LOWER[0]), F.lit(_LOWER[1]))


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def pieces(formatted: Column) -> Column:
    """What follows each ``<|im_start|>``."""
    return F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1 << 30)


def parse_piece(piece: Column) -> Column:
    """Struct of role and text; null where the grammar is broken."""
    role = F.substring_index(piece, "\n", 1)
    body = F.substring(piece, F.length(role) + 2, F.length(piece))
    text = F.substring_index(body, END, 1)
    whole = F.concat(role, F.lit("\n"), text, F.lit(END + "\n")) == piece
    return F.when(whole, F.struct(unescape_role(role).alias("role"), unescape(text).alias("text")))


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``(conv_id, formatted, loss_mask, escaped_turns)`` from ``turns
    (conv_id, turn, role, text)``.  ``loss_mask``: for each turn under the
    loss its number (from 0) and the start and length of its text (code
    points, from 0) within what follows that turn's ``<|im_start|>``."""
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    raw = render(F.col("role"), F.col("text"))
    back = F.transform(pieces(raw), parse_piece)
    same = F.coalesce(back == F.array(F.struct("role", "text")), F.lit(False))
    t = t.withColumn("same", same)
    t = (t.withColumn("role_out", F.when(F.col("same"), F.col("role")).otherwise(escape_role(F.col("role"))))
         .withColumn("text_out", F.when(F.col("same"), F.col("text")).otherwise(escape(F.col("text")))))
    row = F.struct("turn", "role", "text", "role_out", "text_out", "same")
    c = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))
    c = c.withColumn("formatted", F.array_join(F.transform("turns", lambda x: render(x["role_out"], x["text_out"])), ""))
    again = F.transform(pieces(F.col("formatted")), parse_piece)
    source = F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    checked = F.when(F.coalesce(again == source, F.lit(False)), F.col("formatted")).otherwise(
        F.raise_error(F.lit("a formatted conversation does not parse back to its source")))
    mask = F.filter(F.transform("turns", lambda x, i: F.when(x["role"] == loss_role, F.struct(
        i.alias("turn_no"), (F.length(x["role_out"]) + 1).alias("start"), F.length(x["text_out"]).alias("length")))), lambda m: m.isNotNull())
    return c.select("conv_id", checked.alias("formatted"), mask.alias("loss_mask"),
                    F.size(F.filter("turns", lambda x: ~x["same"])).alias("escaped_turns"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digest of each conversation, read from ``formatted`` and ``loss_mask``."""
    f = formatted.withColumn("pieces", pieces(F.col("formatted")))
    f = f.withColumn("turns", F.transform("pieces", parse_piece))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_mask", lambda m: unescape(F.substring(
        F.element_at("pieces", m["turn_no"] + 1), m["start"] + 1, m["length"]))), "")
    return f.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                    F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                    F.length("formatted").cast("long").alias("formatted_chars"))
