"""Chat formatting with a grammar round trip: rendered text is parsed again, and what conflicts is escaped until the turns come back identical."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenia.llm.common import literal

# The template. Each turn is opener, text, closer; openers name the role, closers end the turn. No mark overlaps itself or another.
USER = ("[INST] ", " [/INST]")
ASSISTANT = ("<s> ", " </s>")
#: Any other role: its escaped name stands between "[ROLE " and "] "; a null role is "[ROLE] ".
OTHER = ("[ROLE", " [/ROLE]")
#: What the parser looks for; texts that hold one of them, or a backslash, may need escapes.
CLOSERS = (USER[1], ASSISTANT[1], OTHER[1])
#: One escape for each character with which a mark or an escape can begin or a role can end.
ESCAPES = (("[", "\\b"), ("<", "\\l"), ("]", "\\r"), (" ", "\\s"))


def escaped(x: F.Column) -> F.Column:
    """Reversibly free of marks: backslashes are doubled, brackets named by a backslash and a letter."""
    out = F.replace(x, F.lit("\\"), F.lit("\\\\"))
    for plain, code in ESCAPES[:3]:
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


def unescaped(x: F.Column) -> F.Column:
    """The inverse: pairs of backslashes are taken off first, left to right, and the other escapes read between them."""

    def part(p: F.Column) -> F.Column:
        for plain, code in ESCAPES[:3]:
            p = F.replace(p, F.lit(code), F.lit(plain))
        return p

    return F.when(F.contains(x, F.lit("\\")), F.array_join(F.transform(F.split(x, literal("\\\\"), -1), part), "\\")).otherwise(x)


def rendered(role: F.Column, body: F.Column) -> F.Column:
    """A turn in the template; body is the text, escaped or not."""
    other = F.concat(F.lit(OTHER[0]), F.when(role.isNull(), F.lit("")).otherwise(F.concat(F.lit(" "), escaped(role))), F.lit("] "), body, F.lit(OTHER[1]))
    return F.when(role == "user", F.concat(F.lit(USER[0]), body, F.lit(USER[1]))).when(role == "assistant", F.concat(F.lit(ASSISTANT[0]), body, F.lit(ASSISTANT[1]))).otherwise(other)


def parsed(text: F.Column) -> F.Column:
    """The turns of a rendered text, array<struct<role, text, loss>>: cut after each closer, then each opener tells the role."""
    pieces = F.filter(F.split(text, "(?<=" + "|".join(map(literal, CLOSERS)) + ")", -1), lambda p: p != "")

    def turn(p: F.Column) -> F.Column:
        def inner(start: F.Column, closer: str) -> F.Column:
            return F.substring(p, start + 1, F.length(p) - start - len(closer))

        head = F.regexp_extract(p, r"\A\[ROLE([^\]]*)\] ", 1)
        is_user, is_model = F.startswith(p, F.lit(USER[0])), F.startswith(p, F.lit(ASSISTANT[0]))
        role = F.when(is_user, F.lit("user")).when(is_model, F.lit("assistant")).when(head != "", unescaped(F.substring(head, F.lit(2), F.length(head))))
        body = F.when(is_user, inner(F.lit(len(USER[0])), USER[1])).when(is_model, inner(F.lit(len(ASSISTANT[0])), ASSISTANT[1])).otherwise(inner(F.lit(len(OTHER[0]) + 2) + F.length(head), OTHER[1]))
        return F.struct(role.alias("role"), unescaped(body).alias("text"), is_model.alias("loss"))

    return F.transform(pieces, turn)


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each conversation: conv_id, formatted, turns (parsed again from it), loss_text, escaped_turns, identical.

    Turns go by the turn column, nulls first, then by role and text, so that ties have one order; repeated rows are turns of their own.
    Null text is empty text; a null role, or any other than user and assistant, is rendered with its name. A null conv_id is a
    conversation like others. Other columns are not read; no rows give no rows.
    Each turn is first rendered as it is and parsed by itself; if it doesn't come back identical it is escaped. The whole conversation
    is then parsed and compared with the source, and if it still differs all its turns are escaped; `identical` tells the last comparison.
    loss_text is all that the model is trained on: the assistants' texts in order.
    Marks, escapes and the parser are SQL functions. One shuffle, by conversation; a conversation's turns make one row, as its text must.
    """
    role, text = F.col("role"), F.col("text")
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    suspect = F.contains(text, F.lit("\\"))
    for mark in CLOSERS:
        suspect = suspect | F.contains(text, F.lit(mark.strip()))
    again = parsed(rendered(role, text))
    same = (F.size(again) == 1) & (F.get(again, F.lit(0))["role"].eqNullSafe(role)) & (F.get(again, F.lit(0))["text"] == text)
    rows = rows.withColumn("raw", ~suspect | F.coalesce(same, F.lit(False)))
    one = F.struct("turn", "role", "text", "raw")
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("source"))

    def whole(force: bool) -> F.Column:
        body = lambda t: escaped(t["text"]) if force else F.when(t["raw"], t["text"]).otherwise(escaped(t["text"]))
        return F.array_join(F.transform("source", lambda t: rendered(t["role"], body(t))), "")

    def agrees(turns_: F.Column) -> F.Column:
        plain = F.transform("source", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
        return F.transform(turns_, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).eqNullSafe(plain)

    convs = convs.withColumn("formatted", whole(False)).withColumn("turns", parsed(F.col("formatted"))).withColumn("identical", agrees(F.col("turns")))
    convs = convs.withColumn("formatted", F.when(F.col("identical"), F.col("formatted")).otherwise(whole(True)))
    convs = convs.withColumn("escaped_turns", F.when(F.col("identical"), F.size(F.filter("source", lambda t: ~t["raw"]))).otherwise(F.size("source")))
    convs = convs.withColumn("turns", F.when(F.col("identical"), F.col("turns")).otherwise(parsed(F.col("formatted")))).withColumn("identical", agrees(F.col("turns")))
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return convs.select("conv_id", "formatted", "turns", loss.alias("loss_text"), "escaped_turns", "identical")
