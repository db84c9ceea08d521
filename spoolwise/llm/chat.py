"""Chat formatting: every assistant turn becomes an example of its own, with all turns before it as context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The strings of the template, and what stands for a backslash and for the first character of a control
# string inside a text. An escaped text holds no control string, so a formatted string can be cut at the marks.
OPEN, CLOSE, ASK, ANSWER, SYSTEM, OTHER = "<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[ROLE "
BACKSLASH, ANGLE, BRACKET = r"\b", r"\l", r"\k"


def escape(text: Column) -> Column:
    r"""``\`` becomes ``\b``; the first character of a control string becomes ``\l`` or ``\k``."""
    text = F.replace(text, F.lit("\\"), F.lit(BACKSLASH))
    text = F.regexp_replace(text, r"<(?=/?s>)", r"\\l")
    return F.regexp_replace(text, r"\[(?=/?INST\]|SYS\]|ROLE )", r"\\k")


def unescape(text: Column) -> Column:
    """The inverse of ``escape``; no backslash is left but those that ``escape`` wrote."""
    text = F.replace(F.replace(text, F.lit(ANGLE), F.lit("<")), F.lit(BRACKET), F.lit("["))
    return F.replace(text, F.lit(BACKSLASH), F.lit("\\"))


def _head(role: Column) -> Column:
    known = F.when(role == "user", F.lit(OPEN + ASK)).when(role == "assistant", F.lit(OPEN + ANSWER)).when(
        role == "system", F.lit(OPEN + SYSTEM))
    return F.coalesce(known, F.concat(F.lit(OPEN + OTHER), F.hex(F.encode(F.coalesce(role, F.lit("")), "utf-8")), F.lit("]")))


def format_turn(role: Column, text: Column) -> Column:
    """``<s>[INST]text</s>`` and the like; a role besides the three known ones is spelled in hexadecimal."""
    return F.concat(_head(role), escape(F.coalesce(text, F.lit(""))), F.lit(CLOSE))


def chat_examples(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """``conv``, ``example``, ``formatted``, ``loss_start``, ``loss_end``: one row for each assistant turn, and one more
    with nothing to train on for turns after the last assistant turn.

    ``formatted`` holds all turns up to the target; the loss span, in code points, is the escaped text of that one
    reply. Null texts count as empty, a null role as the role ''. Turns with equal numbers go by role, then text;
    repeated rows stay. An empty table gives no rows, and columns besides the four are not read. A conversation is one
    row while it is formatted, as it is in the output, where each example repeats its context.
    """
    parts = turns.select(
        F.col(conv).alias(conv),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                 F.coalesce(F.col(text), F.lit("")).alias("text")).alias("_t"),
    )
    whole = parts.groupBy(conv).agg(F.sort_array(F.collect_list("_t")).alias("_ts"))
    made = whole.select(
        conv, F.transform("_ts", lambda t: t["role"] == "assistant").alias("_trained"),
        F.transform("_ts", lambda t: format_turn(t["role"], t["text"])).alias("_made"),
        F.transform("_ts", lambda t: F.length(_head(t["role"]))).alias("_heads"),
    )
    at = F.explode(F.filter(F.sequence(F.lit(1), F.size("_made")), lambda n: F.get("_trained", n - 1) | (n == F.size("_made"))))
    rows = made.select("*", at.alias("_n")).select(
        conv, "_n", F.get("_trained", F.col("_n") - 1).alias("_t"), F.get("_heads", F.col("_n") - 1).alias("_h"),
        F.array_join(F.slice("_made", 1, F.col("_n")), "").alias("formatted"),
        F.length(F.get("_made", F.col("_n") - 1)).alias("_len"),
    )
    end = F.length("formatted") - len(CLOSE)
    return rows.select(
        conv, F.col("_n").alias("example"), "formatted",
        F.when(F.col("_t"), F.length("formatted") - F.col("_len") + F.col("_h")).otherwise(F.length("formatted")).alias("loss_start"),
        F.when(F.col("_t"), end).otherwise(F.length("formatted")).alias("loss_end"),
    )


def read_back(examples: DataFrame, conv: str = "conv_id") -> DataFrame:
    """``conv``, ``turns`` (role, text), ``loss`` (the unescaped trained texts in order) and ``formatted_chars``, parsed
    from the formatted strings alone: turns from the longest example, trained texts from every loss span."""
    spans = examples.select(
        conv, "example", F.length("formatted").cast("long").alias("_chars"), "formatted",
        F.when(F.col("loss_end") > F.col("loss_start"), F.expr("substring(formatted, loss_start + 1, loss_end - loss_start)")).otherwise(F.lit("")).alias("_loss"),
    )
    per = spans.groupBy(conv).agg(
        F.max(F.struct("example", "formatted"))["formatted"].alias("_all"), F.sum("_chars").alias("formatted_chars"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "_loss"))), lambda s: s["_loss"]), "").alias("_loss"),
    )
    pieces = F.filter(F.split("_all", CLOSE), lambda p: p != "")
    close = lambda p: F.locate("]", p)  # noqa: E731  where the mark of the role ends

    def role(p: Column) -> Column:
        mark = p.substr(F.lit(len(OPEN) + 1), close(p) - len(OPEN))
        spelled = F.decode(F.unhex(mark.substr(F.lit(len(OTHER) + 1), F.length(mark) - len(OTHER) - 1)), "utf-8")
        return F.when(mark == ASK, "user").when(mark == ANSWER, "assistant").when(mark == SYSTEM, "system").otherwise(spelled)

    body = lambda p: unescape(p.substr(close(p) + 1, F.length(p)))
    turns = F.transform(pieces, lambda p: F.struct(role(p).alias("role"), body(p).alias("text")))
    return per.select(conv, turns.alias("turns"), unescape(F.col("_loss")).alias("loss"), "formatted_chars")
