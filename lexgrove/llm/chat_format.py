"""Chat formatting: a finite-state machine over roles, and segments with loss flags from a declarative template.

A template is plain data: the start state, the transitions state -> role -> state, the accepting states, and for each role its pieces (text, loss flag)
in which ``{text}`` stands for the turn's text; ``begin`` and ``end`` are pieces around a conversation. It is compiled into built-in column
expressions: the turns of a conversation meet in one aggregation, a fold over the ordered turns runs the machine, and a transform emits the pieces.

One row a segment: conv_id, segment (from 0), turn, role, text, loss; ``error`` is null. A conversation that the machine refuses has one row
instead, of segment -1, with the offending turn and role, null text and loss, and the error:

    null_turn      a turn number is null                            repeated_turn   two different rows have one turn number
    order          no transition for the role (null too)            unfinished      the last state isn't accepting

Results for odd input: rows with a null conv_id belong to no conversation and are left out; rows that repeat wholly are one; a null text is an empty one; an
empty text is emitted as it is; of several errors the first in the order above, at the lowest turn, is told; an empty table gives no segments. Other columns are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

TEMPLATE = {
    "start": "start",
    "transitions": {
        "start": {"system": "system", "user": "user"},
        "system": {"user": "user"},
        "user": {"assistant": "assistant"},
        "assistant": {"user": "user", "tool": "tool"},
        "tool": {"assistant": "assistant"},
    },
    "accept": ["assistant"],
    "begin": [("<|begin|>", False)],
    "end": [("<|end|>", True)],
    "roles": {
        "system": [("<|system|>\n", False), ("{text}", False), ("\n", False)],
        "user": [("<|user|>\n", False), ("{text}", False), ("\n", False)],
        "tool": [("<|tool|>\n", False), ("{text}", False), ("\n", False)],
        "assistant": [("<|assistant|>\n", False), ("{text}", True), ("<|stop|>\n", True)],
    },
}

_REFUSED = "\x00refused"


def check_template(template: dict) -> None:
    """ValueError for a machine with unknown states, or a role that it takes but that has no pieces."""
    moves = template["transitions"]
    states = {template["start"], *moves, *(to for by in moves.values() for to in by.values())}
    if missing := set(template["accept"]) - states:
        raise ValueError(f"unknown accepting states: {sorted(missing)}")
    if missing := {r for by in moves.values() for r in by} - set(template["roles"]):
        raise ValueError(f"roles without pieces: {sorted(missing)}")


def _pieces(pieces: list[tuple[str, bool]], turn: Column, role: Column, text: Column) -> Column:
    def piece(words: str, loss: bool) -> Column:
        parts = words.split("{text}")
        said = F.lit(parts[0])
        for part in parts[1:]:
            said = F.concat(said, text, F.lit(part)) if part else (F.concat(said, text) if parts[0] else text)
        return F.struct(turn.alias("turn"), role.alias("role"), said.alias("text"), F.lit(loss).alias("loss"))

    kind = "array<struct<turn:bigint,role:string,text:string,loss:boolean>>"
    return (F.array(*(piece(*p) for p in pieces)) if pieces else F.array()).cast(kind)


def chat_segments(conversations: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    check_template(template)
    moves = [(f"{state}\x00{role}", to) for state, by in template["transitions"].items() for role, to in by.items()]
    step = F.create_map(*(F.lit(x) for move in moves for x in move))
    none = F.lit(None)

    def advance(now: Column, turn: Column) -> Column:
        to = F.coalesce(F.try_element_at(step, F.concat(now["state"], F.lit("\x00"), turn["role"])), F.lit(_REFUSED))
        return F.when(now["state"] == _REFUSED, now).otherwise(F.struct(to.alias("state"), F.when(to == _REFUSED, turn["turn"]).alias("turn"), F.when(to == _REFUSED, turn["role"]).alias("role")))

    rows = conversations.where("conv_id is not null").select("conv_id", F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_set("t")).alias("turns"))
    began = F.struct(F.lit(template["start"]).alias("state"), none.cast("long").alias("turn"), none.cast("string").alias("role"))
    ended = F.aggregate("turns", began, advance)
    last = F.element_at("turns", -1)
    before = F.slice(F.col("turns"), F.lit(1), F.size("turns") - 1)
    twice = F.array_min(F.filter(F.zip_with(before, F.slice(F.col("turns"), F.lit(2), F.size("turns")), lambda a, b: F.when(a["turn"] == b["turn"], a["turn"])), lambda x: x.isNotNull()))
    said = turns.withColumn("ended", ended).withColumn("twice", F.when(F.size("turns") > 1, twice))
    no_turn = F.exists("turns", lambda t: t["turn"].isNull())
    accepted = F.col("ended.state").isin(template["accept"])

    def told(error: str, turn: Column, role: Column) -> Column:
        return F.struct(F.lit(error).alias("error"), turn.cast("long").alias("turn"), role.cast("string").alias("role"))

    error = (
        F.when(no_turn, told("null_turn", none, none)).when(F.col("twice").isNotNull(), told("repeated_turn", F.col("twice"), none))
        .when(F.col("ended.state") == _REFUSED, told("order", F.col("ended.turn"), F.col("ended.role"))).when(~accepted, told("unfinished", last["turn"], last["role"]))
    )
    said = said.withColumn("error", error)
    by_role = F.transform("turns", lambda t: _of_role(template, t))
    segments = F.concat(_pieces(template["begin"], none.cast("long"), none.cast("string"), F.lit("")), F.flatten(by_role), _pieces(template["end"], none.cast("long"), none.cast("string"), F.lit("")))
    refused = F.array(F.struct(F.col("error.turn").alias("turn"), F.col("error.role").alias("role"), none.cast("string").alias("text"), none.cast("boolean").alias("loss")))
    rows = said.select("conv_id", "error.error", F.posexplode(F.when(F.col("error").isNull(), segments).otherwise(refused)).alias("segment", "s"))
    number = F.when(F.col("error").isNotNull(), F.lit(-1)).otherwise(F.col("segment"))
    return rows.select("conv_id", number.alias("segment"), "s.turn", "s.role", "s.text", "s.loss", "error")


def _of_role(template: dict, t: Column) -> Column:
    chosen = _pieces([], t["turn"], t["role"], t["text"])
    for role, pieces in template["roles"].items():
        chosen = F.when(t["role"] == role, _pieces(pieces, t["turn"], t["role"], t["text"])).otherwise(chosen)
    return chosen


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_segments(table(spark, sf_dir, "conversations"))


#: The machine of TEMPLATE is in the state of the last role, so windows over the turns say the same.
ORACLE_SQL = """
with d as (
  select distinct conv_id, turn, role, coalesce(text, '') as text from conversations where conv_id is not null
), o as (
  select *, row_number() over w as k, count(*) over (partition by conv_id) as n, lag(role) over w as before_role,
    max(case when turn is null then 1 else 0 end) over (partition by conv_id) as no_turn,
    count(*) over (partition by conv_id, turn) as same
  from d window w as (partition by conv_id order by turn nulls first, role nulls first, text)
), f as (
  select *, coalesce(case
      when k = 1 then role in ('system', 'user')
      when before_role = 'system' then role = 'user'
      when before_role = 'user' or before_role = 'tool' then role = 'assistant'
      when before_role = 'assistant' then role in ('user', 'tool') end, false) as allowed
  from o
), c as (
  select conv_id, max(no_turn) as no_turn, min(case when same > 1 then turn end) as twice,
    min(case when not allowed then k end) as bad, max(n) as n from f group by conv_id
), e as (
  select c.*, l.turn as last_turn, l.role as last_role, b.turn as bad_turn, b.role as bad_role,
    case when c.no_turn = 1 then 'null_turn' when c.twice is not null then 'repeated_turn' when c.bad is not null then 'order'
      when l.role <> 'assistant' then 'unfinished' end as error
  from c join f l on l.conv_id = c.conv_id and l.k = c.n left join f b on b.conv_id = c.conv_id and b.k = c.bad
), pieces as (
  select f.conv_id, 3 * (f.k - 1) + p.j + 1 as segment, f.turn, f.role,
    case p.j when 0 then '<|' || f.role || '|>' || chr(10) when 1 then f.text
      else case when f.role = 'assistant' then '<|stop|>' || chr(10) else chr(10) end end as text,
    f.role = 'assistant' and p.j > 0 as loss
  from f join e using (conv_id) cross join (values (0), (1), (2)) p(j) where e.error is null
  union all select conv_id, 0, null, null, '<|begin|>', false from e where error is null
  union all select conv_id, 3 * n + 1, null, null, '<|end|>', true from e where error is null
)
select conv_id, cast(segment as integer) as segment, turn, role, text, loss, cast(null as varchar) as error from pieces
union all
select conv_id, -1, case error when 'repeated_turn' then twice when 'order' then bad_turn when 'unfinished' then last_turn end,
  case error when 'order' then bad_role when 'unfinished' then last_role end, null, null, error
from e where error is not null
"""
