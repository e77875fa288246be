"""Preference formatting: chosen and rejected conversations as one prompt and two masked completions, natively.

The longest common prefix of both turn lists is rendered once as the prompt; what follows is each side's completion.
Completions carry spans (start, end, trained): character ranges of the completion, of which only assistant replies
are trained on; headers and other roles' turns are masked.

A turn is rendered as ``<|role|>\n`` + text + ``<|end|>\n``; these parts are parameters. Conversations meet on a pair
id, each as one row of its own turns in order, so no group is larger than a conversation.

Defined results: turns are ordered by turn, then role and text; null roles and texts count as empty. Repeated turns stay, each
a turn. Equal sides give empty completions. A side without turns has an empty completion. A pair with one side only is
paired with an empty one. Turns of a null pair id are left out, as nothing says which belong together. Texts of any
length are rendered whole. Extra columns are ignored. An empty table gives an empty result. A conversation is one row, so it must fit
the memory of a task: some hundred MB; a table whose turns share one id is not a table of conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: What stands before a role, after it, and after a turn's text.
MARKS = ("<|", "|>\n", "<|end|>\n")
TRAINED_ROLE = "assistant"


def conversations(turns: DataFrame, key: str, into: str) -> DataFrame:
    """(key, into): each conversation's turns in order as array<struct<role, text>>."""
    row = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = turns.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(row)).alias(into))
    return whole.withColumn(into, F.transform(into, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))


def _header(role: Column) -> Column:
    return F.concat(F.lit(MARKS[0]), role, F.lit(MARKS[1]))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t["role"]), t["text"], F.lit(MARKS[2]))), "")


def spans(turns: Column) -> Column:
    """Character ranges of a rendered turn list: each header masked, each reply with its end mark trained if it is the assistant's."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,trained:boolean>>").alias("out"))

    def step(state: Column, t: Column) -> Column:
        head = (state["at"] + F.length(_header(t["role"]))).cast("int")
        end = (head + F.length(t["text"]) + len(MARKS[2])).cast("int")
        part = lambda a, b, on: F.struct(a.alias("start"), b.alias("end"), on.alias("trained"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(part(state["at"], head, F.lit(False)), part(head, end, t["role"] == TRAINED_ROLE))).alias("out"))

    return F.aggregate(turns, start, step, lambda s: s["out"])


def common_turns(a: Column, b: Column) -> Column:
    """The number of leading turns that both lists share."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def format_pairs(chosen: DataFrame, rejected: DataFrame, key: str = "pair_id") -> DataFrame:
    """Pairs of two turn tables (key, turn, role, text).

    Result: key, prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans.
    """
    return format_lists(conversations(chosen, key, "c"), conversations(rejected, key, "r"), key)


def format_lists(chosen: DataFrame, rejected: DataFrame, key: str = "pair_id") -> DataFrame:
    """The same of conversations already in lists (key, c) and (key, r)."""
    none = F.array().cast("array<struct<role:string,text:string>>")
    return format_sides(chosen.join(rejected, key, "full_outer").select(key, F.coalesce("c", none).alias("c"), F.coalesce("r", none).alias("r")), key)


def format_sides(both: DataFrame, key: str = "pair_id") -> DataFrame:
    """The same of both sides in one row (key, c, r)."""
    both = both.withColumn("prompt_turns", common_turns(F.col("c"), F.col("r")))
    rest = lambda side: F.slice(side, F.col("prompt_turns") + 1, F.greatest(F.size(side) - F.col("prompt_turns"), F.lit(0)))
    both = both.select(key, "prompt_turns", F.slice("c", F.lit(1), F.col("prompt_turns")).alias("p"), rest(F.col("c")).alias("c"), rest(F.col("r")).alias("r"))
    return both.select(key, "prompt_turns", render(F.col("p")).alias("prompt"), render(F.col("c")).alias("chosen"), render(F.col("r")).alias("rejected"), spans(F.col("c")).alias("chosen_spans"), spans(F.col("r")).alias("rejected_spans"))


def with_earlier_reply(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """(pair_id, c, r): chosen and rejected sides from plain conversations.

    Chosen is a conversation up to its last assistant turn; rejected has the same turns but for the last reply, in
    whose place stands the assistant's reply before it, or an empty one. Conversations without an assistant turn make no pair.
    """
    whole = conversations(turns, key, "c")
    last = F.size("c") - F.array_position(F.reverse(F.transform("c", lambda t: t["role"] == TRAINED_ROLE)), True) + 1
    whole = whole.where(F.exists("c", lambda t: t["role"] == TRAINED_ROLE)).select(F.col(key).alias("pair_id"), F.slice("c", F.lit(1), last.cast("int")).alias("c"))
    before = F.filter(F.slice("c", F.lit(1), F.size("c") - 1), lambda t: t["role"] == TRAINED_ROLE)
    reply = F.coalesce(F.try_element_at(before, F.lit(-1))["text"], F.lit(""))
    other = F.concat(F.slice("c", F.lit(1), F.size("c") - 1), F.array(F.struct(F.lit(TRAINED_ROLE).alias("role"), reply.alias("text"))))
    return whole.select("pair_id", "c", other.alias("r"))


def preference_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: a preference pair of every conversation with a reply."""
    out = format_sides(with_earlier_reply(table(spark, sf_dir, "conversations")))
    mask = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"], s["end"], F.when(s["trained"], 1).otherwise(0))), ",")
    return out.select(F.col("pair_id").alias("conv_id"), F.col("prompt_turns").cast("long").alias("prompt_turns"), "prompt", "chosen", "rejected", mask("chosen_spans").alias("chosen_mask"), mask("rejected_spans").alias("rejected_mask"))


ORACLE = r"""
with a as (select conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} order by turn, role, text) c from conversations where conv_id is not null group by conv_id),
b as (select conv_id, c[1:list_max(list_filter(range(1, len(c) + 1), lambda i: c[i].role = 'assistant'))] c from a where len(list_filter(c, lambda t: t.role = 'assistant')) > 0),
d as (select conv_id, c, coalesce(list_filter(c[1:len(c) - 1], lambda t: t.role = 'assistant')[-1].text, '') reply from b),
e as (select conv_id, c, reply, c[len(c)].text final from d),
f as (select conv_id, case when reply = final then len(c) else len(c) - 1 end prompt_turns, c, reply, final from e),
g as (select *, '<|assistant|>' || chr(10) head, '<|end|>' || chr(10) tail from f)
select conv_id, cast(prompt_turns as bigint) prompt_turns, coalesce(array_to_string(list_transform(c[1:prompt_turns], lambda t: '<|' || t.role || '|>' || chr(10) || t.text || tail), ''), '') prompt,
  case when reply = final then '' else head || final || tail end chosen, case when reply = final then '' else head || reply || tail end rejected,
  case when reply = final then '' else '0:14:0,14:' || (14 + length(final) + 8) || ':1' end chosen_mask,
  case when reply = final then '' else '0:14:0,14:' || (14 + length(reply) + 8) || ':1' end rejected_mask from g
"""
