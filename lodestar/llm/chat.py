r"""Chat formatting with a grammar round trip, in DataFrame functions only.

    conversation = turn*
    turn         = "[INST] " text " [/INST]"            role user
                 | "<s>" text "</s>"                     role assistant
                 | "<<" role ">>" text "<</>>"           any other role

A text ends at the first closing marker. Within a turn, a backslash followed by
a second one stands for one backslash, and a backslash before anything else is
dropped.

The round trip goes on until it is identical. A turn is rendered with its text
as it is, parsed, and compared with the source; where role and text differ,
control strings and backslashes are escaped, and it is parsed and compared
again; where they still differ, each character that markers are made of is
escaped, and it is parsed and compared once more. Then the turns of a
conversation are joined, the whole is parsed and compared with all its turns,
and where it differs it is rendered anew with each turn escaped further. What
differs even then raises an error instead of being returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TURN = r"(?s)\[INST\] (.*?) \[/INST\]|<s>(.*?)</s>|<<(.*?)>>(.*?)<</>>"
CLOSED = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>")}


#: How far roles and texts can be escaped: not, control strings, each character of a marker.
LEVELS = 3
_CONTROL = (r"([\[<>])(?=/?INST\]|/?s>|<|>)", r"([\[\]<>])")


def escape(text: Column, level: int = 1) -> Column:
    """Doubles backslashes and puts one inside each control string, or after each character of a marker."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, _CONTROL[level - 1], "$1\\\\") if level else text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def render(role: Column, text: Column, level: int) -> Column:
    """A turn as the grammar has it. Other roles than the two known ones are escaped at any level, a ``>`` at their end too."""
    body = escape(text, level)
    out = F.concat(F.lit("<<"), escape(role, 2 if level == 2 else 1), F.lit(">>"), body, F.lit("<</>>"))
    for name, (head, tail) in CLOSED.items():
        out = F.when(role == name, F.concat(F.lit(head), body, F.lit(tail))).otherwise(out)
    return out


def parsed_role(piece: Column) -> Column:
    out = unescape(F.regexp_extract(piece, TURN, 3))
    for name, (head, _) in CLOSED.items():
        out = F.when(piece.startswith(F.lit(head)), F.lit(name)).otherwise(out)
    return out


def parsed_body(piece: Column) -> Column:
    """What stands between the markers, still escaped."""
    return F.concat(*[F.regexp_extract(piece, TURN, i) for i in (1, 2, 4)])


def reads_back(piece: Column, role: Column, text: Column) -> Column:
    """Whether the parser, from the start of the piece, takes all of it as one turn with this role and text."""
    return (F.regexp_extract(piece, TURN, 0) == piece) & (parsed_role(piece) == role) & (unescape(parsed_body(piece)) == text)


def _whole(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): the sorted turns of each conversation. Rows without conv_id are not gathered: there may be any number of them."""
    struct = F.struct("turn", "role", "text", "piece")
    gathered = rows.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list(struct)).alias("turns"))
    return gathered.unionByName(rows.where("conv_id IS NULL").select("conv_id", F.array(struct).alias("turns")))


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted) of each conversation in ``rows`` (conv_id, turn, role, text; other columns are ignored).

    Turns in order of turn, then role, then text; null roles and texts count
    as empty, null turns come first, each row with null conv_id is a conversation
    of its own, repeated rows are repeated turns, and an empty table gives an
    empty result. One string holds a conversation; its turns are rendered and
    compared before they meet.
    """
    turns = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    role, text = F.col("role"), F.col("text")
    # the least escaped piece that reads back; where none does, the last, which is found out below
    piece = render(role, text, LEVELS - 1)
    for level in reversed(range(LEVELS - 1)):
        own = render(role, text, level)
        piece = F.when(reads_back(own, role, text), own).otherwise(piece)
    whole = _whole(turns.withColumn("piece", piece)).withColumn("formatted", F.array_join(F.transform("turns", lambda t: t["piece"]), ""))
    source = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    formatted = F.raise_error(F.lit("a conversation does not read back as its turns"))
    for level in reversed(range(1, LEVELS)):  # looked at only where the pieces together don't read back
        further = F.array_join(F.transform("turns", _rendered(level)), "")
        formatted = F.when(_told(further) == source, further).otherwise(formatted)
    return whole.select("conv_id", F.when(_told(F.col("formatted")) == source, F.col("formatted")).otherwise(formatted).alias("formatted"))


def _rendered(level: int):
    return lambda t: render(t["role"], t["text"], level)


def _told(formatted: Column) -> Column:
    """Role and text of each turn that the parser finds."""
    pieces = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0))
    return F.transform(pieces, lambda p: F.struct(parsed_role(p).alias("role"), unescape(parsed_body(p)).alias("text")))


def parse_conversations(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns) of (conv_id, formatted): the parser's turns, each with role, text and loss.

    ``loss`` marks the turns whose text, and not the markers around it, is
    under the loss mask: those of the assistant.
    """
    pieces = F.regexp_extract_all("formatted", F.lit(TURN), F.lit(0))
    one = lambda p: F.struct(parsed_role(p).alias("role"), unescape(parsed_body(p)).alias("text"))
    turns = F.transform(pieces, lambda p: F.struct(one(p)["role"].alias("role"), one(p)["text"].alias("text"), p.startswith(F.lit("<s>")).alias("loss")))
    return formatted.select("conv_id", "formatted", turns.alias("turns"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read back from the formatted ``conversations``, and from conversation -1 with conflicting texts.

    Null roles and texts are empty, each row with null conv_id is a conversation
    of its own, repeated rows are repeated turns, further columns are ignored,
    and of an empty table conversation -1 alone is left.
    """
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    conflict = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        F.lit(conflict).alias("text"),
    )
    read = parse_conversations(format_conversations(rows.unionByName(more)))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
