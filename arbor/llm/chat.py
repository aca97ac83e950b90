"""Chat formatting by prefix-target expansion, with built-in functions only.

A turn of role ``assistant`` is rendered ``<s>text</s>``, any other ``[INST]role, newline, text[/INST]``. Inside texts and
roles the five strings of ``ESCAPES`` are replaced, so those marks are found nowhere but around turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is replaced inside texts, first to last; taken back from last to first.
ESCAPES = (("~", "~0"), ("<s>", "~1"), ("</s>", "~2"), ("[INST]", "~3"), ("[/INST]", "~4"))
#: A role also has its line ends replaced.
ROLE_ESCAPES = (*ESCAPES, ("\n", "~5"))


def _replaced(text: Column, pairs) -> Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escaped(text: Column, pairs=ESCAPES) -> Column:
    return _replaced(text, pairs)


def unescaped(text: Column, pairs=ESCAPES) -> Column:
    return _replaced(text, [(b, a) for a, b in reversed(pairs)])


def format_prefix_targets(conversations: DataFrame) -> DataFrame:
    """One row for each assistant turn: conv_id, example (from 0), context, target, loss_start, loss_chars.

    ``context`` holds all preceding turns, ``target`` the reply with its marks; the mask covers ``loss_chars`` code points
    from ``loss_start`` of context and target taken together, which is the reply's text alone. Turns after the last reply
    follow as one more example without a mask (null loss_start), so that no turn is lost. A conversation's turns are sorted
    by turn, role and text, nulls first; null roles and texts are empty; a null conv_id is a conversation of its own.

    A conversation is gathered into one row, as its replies need all turns before them; prefixes are cut from that row one
    example at a time, so a task holds a conversation and one of its examples.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    reply = role == "assistant"
    rendered = F.when(reply, F.concat(F.lit("<s>"), escaped(text), F.lit("</s>"))).otherwise(
        F.concat(F.lit("[INST]"), escaped(role, ROLE_ESCAPES), F.lit("\n"), escaped(text), F.lit("[/INST]"))
    )
    turns = conversations.select(
        "conv_id", F.struct("turn", role.alias("role"), text.alias("text"), rendered.alias("rendered"), reply.alias("reply")).alias("t")
    )
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    places = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.element_at("turns", i)["reply"] | (i == F.size("turns")))
    each = whole.select("conv_id", F.col("turns.rendered").alias("rendered"), F.col("turns.reply").alias("reply"), F.posexplode(places).alias("example", "at"))
    own = F.element_at("rendered", F.col("at"))
    is_reply = F.element_at("reply", F.col("at"))
    context = F.array_join(F.slice("rendered", F.lit(1), F.col("at") - 1), "")
    return each.select(
        "conv_id",
        "example",
        context.alias("context"),
        own.alias("target"),
        F.when(is_reply, F.char_length(context) + 3).cast("long").alias("loss_start"),
        F.when(is_reply, F.char_length(own) - 7).otherwise(0).cast("long").alias("loss_chars"),
        (F.col("at") == F.size("rendered")).alias("is_last"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """What the examples of each conversation hold, taken from their formatted text and mask: conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars (over all its examples) and n_examples."""
    formatted = F.concat("context", "target")
    masked = F.when(F.col("loss_start").isNotNull(), unescaped(F.substring(formatted, F.col("loss_start").cast("int") + 1, F.col("loss_chars").cast("int"))))
    rows = examples.select(
        "conv_id",
        F.struct("example", masked.alias("text")).alias("loss"),
        F.when(F.col("is_last"), formatted).alias("whole"),
        F.char_length(formatted).cast("long").alias("chars"),
    )
    whole = rows.groupBy("conv_id").agg(
        F.concat_ws("", F.array_sort(F.collect_list("loss"))["text"]).alias("loss"),
        F.max("whole").alias("whole"),
        F.sum("chars").alias("formatted_chars"),
        F.count("*").alias("n_examples"),
    )
    marked = F.split("whole", r"(?<=</s>)|(?<=\[/INST\])")
    marked = F.filter(marked, lambda t: F.char_length(t) > 0)

    def turn(t: Column) -> Column:
        other = F.substring(t, 7, 1 << 30)
        other = F.substring(other, F.lit(1), F.char_length(other) - 7)
        line = F.locate("\n", other)
        return F.when(
            t.startswith("<s>"), F.concat(F.lit("assistant\n"), unescaped(F.substring(t, F.lit(4), F.char_length(t) - 7)), F.lit("\n"))
        ).otherwise(
            F.concat(
                unescaped(F.substring(other, F.lit(1), line - 1), ROLE_ESCAPES),
                F.lit("\n"),
                unescaped(F.substring(other, line + 1, F.char_length(other))),
                F.lit("\n"),
            )
        )

    return whole.select(
        "conv_id",
        F.size(marked).cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform(marked, turn), "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        F.col("n_examples").cast("long").alias("n_examples"),
    )


def control_conversation(spark) -> DataFrame:
    """Conversation -1, whose texts consist of the template's own marks."""
    text = "</s>[INST] ok [/INST]"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    return spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(text).alias("text"))


ORACLE_SQL = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized as (
  select *, role = 'assistant' as reply,
    length(replace(replace(replace(replace(replace(text, '~', '~0'), '<s>', '~1'), '</s>', '~2'), '[INST]', '~3'), '[/INST]', '~4'))
    + case when role = 'assistant' then 7 else 14 + length(replace(replace(replace(replace(replace(replace(role, '~', '~0'), '<s>', '~1'), '</s>', '~2'), '[INST]', '~3'), '[/INST]', '~4'), chr(10), '~5')) end as chars,
    row_number() over (partition by conv_id order by turn, role, text) as k,
    count(*) over (partition by conv_id) as n
  from rows
), summed as (
  select *, sum(chars) over (partition by conv_id order by k rows unbounded preceding) as so_far from sized
)
select conv_id, cast(count(*) as bigint) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  cast(sum(case when reply then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when reply then text end, '' order by k), '')) as loss_sha256,
  cast(sum(case when reply or k = n then so_far else 0 end) as bigint) as formatted_chars,
  cast(count(*) filter (reply or k = n) as bigint) as n_examples
from summed group by conv_id
"""
