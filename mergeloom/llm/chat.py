"""Chat formatting with a grammar round trip, in DataFrame operations only.

A conversation is the concatenation of its turns:

    system      [SYS]text[/SYS]
    user        [INST]text[/INST]
    assistant   <s>text</s>
    other       [TURN]role, a line feed, text[/TURN]

A turn is first rendered as it is and parsed again. Where the parser doesn't give
back the turn, its content is escaped: every control string in it, and everything
that looks like an escaped one, gets one more backslash after its first character.
Unescaping takes one away, so an escaped text holds no control string and comes
back for certain. The parser unescapes always.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Role, opening and closing control string. The last is for all other roles.
MARKS = (("system", "[SYS]", "[/SYS]"), ("user", "[INST]", "[/INST]"), ("assistant", "<s>", "</s>"), (None, "[TURN]", "[/TURN]"))
CONTROL = r"\[/?(?:SYS|INST|TURN)\]|</?s>"
_TAIL = r"(/?(?:SYS|INST|TURN)\]|/?s>)"
ESCAPE = (r"([\[<])(\\*)" + _TAIL, r"$1\\$2$3")
UNESCAPE = (r"([\[<])\\(\\*)" + _TAIL, r"$1$2$3")


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, *ESCAPE)


def _content(role: Column, text: Column) -> Column:
    """What stands between a turn's marks; an unusual role stands before the text."""
    known = role.isin([r for r, _, _ in MARKS if r])
    line = F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))
    return F.when(known, text).otherwise(F.concat(line, F.lit("\n"), text))


def _marked(role: Column, content: Column) -> Column:
    out = F.concat(F.lit(MARKS[-1][1]), content, F.lit(MARKS[-1][2]))
    for r, a, b in MARKS[:-1]:
        out = F.when(role == r, F.concat(F.lit(a), content, F.lit(b))).otherwise(out)
    return out


def parsed(formatted: str) -> str:
    """SQL: the turns (role, text) of a formatted conversation; null where it breaks the grammar."""
    split, controls = f"split({formatted}, r'{CONTROL}')", f"regexp_extract_all({formatted}, r'{CONTROL}', 0)"
    pairs = " OR ".join(f"(m[2 * i] = '{a}' AND m[2 * i + 1] = '{b}')" for _, a, b in MARKS)
    body = f"regexp_replace(b[2 * i + 1], r'{UNESCAPE[0]}', r'{UNESCAPE[1]}')"
    names = " ".join(f"WHEN m[2 * i] = '{a}' THEN named_struct('role', '{r}', 'text', {body})" for r, a, _ in MARKS if r)
    other = f"named_struct('role', replace(replace(substring_index({body}, '\\n', 1), '%0A', '\\n'), '%25', '%'), 'text', substring({body}, instr({body}, '\\n') + 1))"
    turn = f"CASE {names} ELSE {other} END"
    sound = f"size(m) % 2 = 0 AND size(m) > 0 AND forall(sequence(0, size(m) div 2 - 1), i -> ({pairs}) AND b[2 * i] = '') AND b[size(b) - 1] = ''"
    inner = f"(m, b) -> CASE WHEN {sound} THEN transform(sequence(0, size(m) div 2 - 1), i -> {turn}) END"
    # a one-element zip gives names to the two arrays
    return f"element_at(zip_with(array({controls}), array({split}), {inner}), 1)"


def formatted(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, formatted, n_source, round_trip), a row for each conversation.

    Turns are ordered by turn, then role and text, nulls first. Null roles and texts are
    empty ones. Rows with a null conversation form one. Repeated rows are turns of their
    own; a conversation is one value, as its digest needs it, whatever its length; each
    turn is rendered and checked before the turns are brought together.
    """
    turns = conversations.select(F.col(id_col).alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.withColumn("plain", _marked(F.col("role"), _content(F.col("role"), F.col("text"))))
    turns = turns.withColumn("back", F.expr(parsed("plain")))
    same = F.coalesce((F.size("back") == 1) & (F.expr("back[0].role") == F.col("role")) & (F.expr("back[0].text") == F.col("text")), F.lit(False))
    turns = turns.withColumn("marked", F.when(same, F.col("plain")).otherwise(_marked(F.col("role"), escaped(_content(F.col("role"), F.col("text"))))))
    key = F.struct("turn", "role", "text", "marked")
    one = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(key)).alias("t"))
    one = one.select("conv_id", F.expr("array_join(transform(t, x -> x.marked), '')").alias("formatted"), F.expr("sha2(array_join(transform(t, x -> concat(x.role, '\\n', x.text, '\\n')), ''), 256)").alias("source_sha256"), F.size("t").alias("n_source"))
    one = one.withColumn("turns", F.expr(parsed("formatted")))
    digest = F.expr("sha2(array_join(transform(turns, x -> concat(x.role, '\\n', x.text, '\\n')), ''), 256)")
    one = one.withColumn("turns_sha256", digest)
    return one.withColumn("round_trip", F.coalesce((F.size("turns") == F.col("n_source")) & (F.col("turns_sha256") == F.col("source_sha256")), F.lit(False)))


def digests(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What is read back from the formatted text: turns, and the text under the loss mask (assistant texts)."""
    loss = F.expr("array_join(transform(filter(turns, x -> x.role = 'assistant'), x -> x.text), '')")
    back = formatted(conversations, id_col).withColumn("loss", loss)
    return back.select("conv_id", F.coalesce(F.size("turns"), F.lit(0)).cast("long").alias("n_turns"), "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "round_trip")
