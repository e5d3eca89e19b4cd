r"""Chat formatting by a grammar round trip, in DataFrame operations only.

Grammar of a formatted conversation (one string):

    conversation := turn*
    turn         := "<s>" role "[INST]" text "[/INST]" "</s>"

No role or text may contain a control string, that is "<s>", "</s>", "[INST]" or "[/INST]". A turn is
rendered as it is and parsed again; if the parser does not give back role and text, its content is
escaped by a backslash after the first character of each control string, one more if it has some
there already, and the turn is rendered again. The parser drops one such backslash, so escaping is
reversible. The whole conversation is then parsed and compared with its source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, HEAD, TAIL, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
_STRINGS = r"(/?(?:s>|INST\]))"
#: A control string, whole, with any number of backslashes after its first character.
CONFLICT = rf"([<\[])(\\*){_STRINGS}"
CONTROL = r"</?s>|\[/?INST\]"
_ESCAPED = rf"([<\[])\\(\\*){_STRINGS}"


def escaped(c: Column) -> Column:
    return F.regexp_replace(c, CONFLICT, r"$1$2\\$3")


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, _ESCAPED, "$1$2$3")


def _render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(HEAD), text, F.lit(TAIL + CLOSE))


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation: the deterministic parser of the grammar.

    A turn ends at the first "[/INST]</s>", its role at the first "[INST]" after "<s>". A role or text
    that still holds a control string is no sentence of the grammar and comes back as null.
    """
    pieces = F.split(formatted, r"\[/INST\]</s>", -1)
    turns = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(p: Column) -> Column:
        body = F.substring(p, F.lit(len(OPEN) + 1), F.length(p))
        at = F.locate(HEAD, body)
        content = lambda c: F.when(~c.rlike(CONTROL), unescaped(c))
        return F.struct(content(F.substring(body, F.lit(1), at - 1)).alias("role"), content(F.substring(body, at + len(HEAD), F.length(body))).alias("text"))

    return F.transform(turns, turn)


def loss_spans(formatted: Column) -> Column:
    """Ranges (start from 0, length, in code points) of the texts of "assistant" turns, found by the grammar alone."""
    pieces = F.split(formatted, r"\[/INST\]</s>", -1)
    turns = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))

    def step(acc: Column, p: Column) -> Column:
        begin = F.locate(HEAD, p) + len(HEAD) - 1
        role = F.substring(p, F.lit(len(OPEN) + 1), begin - len(HEAD) - len(OPEN))
        span = F.struct((acc["at"] + begin).cast("long").alias("start"), (F.length(p) - begin).cast("long").alias("length"))
        spans = F.when(role == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((acc["at"] + F.length(p) + len(TAIL + CLOSE)).cast("long").alias("at"), spans.alias("spans"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def _turn(role: Column, text: Column) -> Column:
    """A turn as it is if it parses back to itself, else escaped."""
    plain = _render(role, text)
    parsed = parse(plain)
    same = (F.size(parsed) == 1) & (F.get(parsed, F.lit(0)).eqNullSafe(F.struct(role.alias("role"), text.alias("text"))))
    return F.when(same, plain).otherwise(_render(escaped(role), escaped(text)))


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, turns (parsed back), round_trip, loss_spans.

    Rows go by turn; rows of one turn by role, then text; a null turn first. A null text or role is
    empty. A null conv_id is a conversation. round_trip tells whether the parser's turns equal the
    source; it is true for any input. loss_spans is the loss mask over formatted: the (escaped) texts of
    turns whose role is "assistant". An empty table gives an empty result; other columns are not read.
    """
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("rendered", _turn(F.col("role"), F.col("text")))
    each = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "rendered"))).alias("rows"))
    each = each.select("conv_id", F.array_join(F.col("rows.rendered"), "").alias("formatted"), F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("source"))
    each = each.withColumn("turns", parse(F.col("formatted")))
    return each.select("conv_id", "formatted", "turns", F.col("turns").eqNullSafe(F.col("source")).alias("round_trip"), loss_spans(F.col("formatted")).alias("loss_spans"))


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations: turn count, digests of turns and of the text under the loss mask."""
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    under = lambda s: unescaped(F.substring(F.col("formatted"), s["start"].cast("int") + 1, s["length"].cast("int")))
    loss = F.array_join(F.transform("loss_spans", under), "")
    return formatted.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(line, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "round_trip",
    )
