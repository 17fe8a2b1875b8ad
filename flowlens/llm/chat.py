"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns are its
context and only that reply is trainable.  A turn is

    <|turn|>role<|text|>text<|end|>

and an example is the turns up to its reply; ``loss_start`` and ``loss_end``
(code points, end exclusive) bound the reply's text in it.  Inside roles and
texts a backslash becomes two and ``<|`` becomes ``<\\|``, so no text can form a
control string, and unescaping gives the text back exactly.

Turns after the last reply stand in no example's context.  A conversation that
does not end with a reply so has one more row, without a trainable part
(``loss_start`` and ``loss_end`` null), that carries them; it keeps the output
reversible and a trainer skips it.

Defined cases: a null text or role is the empty string; a null turn number comes
before all others, and equal ones go by role, then text; repeated rows are
repeated turns; rows with a null conv_id are one conversation.  An empty table
gives no rows.  An example's size grows with its conversation; a conversation is
never split, since a reply needs its whole context.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
TRAINED = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def prefix_examples(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                    text_col: str = "text") -> DataFrame:
    """conv_id, example (index of its last turn), formatted, loss_start, loss_end."""
    empty = F.lit("")
    per = turns.groupBy(turns[id_col].alias("conv_id")).agg(F.sort_array(F.collect_list(F.struct(
        turns[turn_col].alias("turn"), F.coalesce(turns[role_col], empty).alias("role"),
        F.coalesce(turns[text_col], empty).alias("text")))).alias("turns"))
    per = per.withColumn("marked", F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT)).alias("head"), escape(t["text"]).alias("body"),
        (t["role"] == TRAINED).alias("trained"))))
    last = F.size("marked") - 1
    ends = F.filter(F.sequence(F.lit(0), last),
                    lambda i: F.get("marked", i)["trained"] | (i == F.size("marked") - 1))
    one = per.select("conv_id", "marked", F.explode(ends).alias("example"))
    whole = F.transform(F.slice("marked", 1, F.col("example") + 1),
                        lambda m: F.concat(m["head"], m["body"], F.lit(END)))
    at = F.get("marked", F.col("example"))
    one = one.select("conv_id", "example", F.array_join(whole, "").alias("formatted"),
                     F.when(at["trained"], F.char_length(at["body"])).alias("body_chars"))
    stop = F.char_length("formatted") - len(END)
    return one.select("conv_id", "example", "formatted",
                      F.when(F.col("body_chars").isNotNull(), stop - F.col("body_chars")).cast("long").alias("loss_start"),
                      F.when(F.col("body_chars").isNotNull(), stop).cast("long").alias("loss_end"))


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, what its examples say: the turns (role, text) and the trained texts, in order."""
    per = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("longest"),
        F.sum(F.char_length("formatted")).alias("formatted_chars"),
        F.sort_array(F.collect_list(F.when(F.col("loss_start").isNotNull(), F.struct(
            "example", F.substring("formatted", F.col("loss_start").cast("int") + 1,
                                   (F.col("loss_end") - F.col("loss_start")).cast("int")).alias("masked")))))
        .alias("masked"))
    pieces = F.filter(F.split("longest", r"<\|end\|>"), lambda x: x != "")
    turn = lambda x: F.split(F.substring(x, len(TURN) + 1, 2**31 - 1), r"<\|text\|>")
    return per.select("conv_id", F.transform(pieces, lambda x: F.struct(
        unescape(F.get(turn(x), F.lit(0))).alias("role"), unescape(F.get(turn(x), F.lit(1))).alias("text"))).alias("turns"),
        F.transform("masked", lambda m: unescape(m["masked"])).alias("trained"), "formatted_chars")


def op9_prefix_examples(conversations: DataFrame) -> DataFrame:
    """The digest of ``read_back`` over all conversations and conversation -7, whose texts hold control strings."""
    odd = conversations.sparkSession.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(TRAINED).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = conversations.select("conv_id", F.col("turn").cast("long"), "role", "text").unionByName(odd)
    back = read_back(prefix_examples(rows))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    trained = F.array_join("trained", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.char_length(trained).cast("long").alias("loss_chars"), F.sha2(trained, 256).alias("loss_sha256"),
                       F.col("formatted_chars").cast("long"))


ORACLE_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), numbered AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|'))
      + length('<|turn|><|text|><|end|>') AS chars
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), examples AS (
  SELECT *, count(*) FILTER (WHERE role = 'assistant' OR i = n)
    OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS standing
  FROM numbered
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars * standing)::BIGINT AS formatted_chars
FROM examples GROUP BY conv_id
"""
