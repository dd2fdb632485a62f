r"""Chat formatting by event-sourced reconstruction (operator 7; DataFrame functions only).

A log of events is folded into each conversation's final messages, which are then
rendered. Events have conv_id, seq, kind, msg (the message's place), role, text:

- ``message`` opens a message (text may be empty),
- ``delta`` adds text to it,
- ``edit`` replaces its text,
- ``regenerate`` empties it, and drops the messages after it that were not opened again since.

Within a message the events from its last message, edit or regenerate on make
up its text. Template: ``### Role: text</turn>\n`` for each turn; in roles and texts
``\`` becomes ``\s``, ``###`` ``\h``, ``</turn>`` ``\t``, and in roles also ``:`` ``\c``,
so no marker occurs inside and the change is reversible. The loss mask is a list of
[start, end) code point offsets of assistant texts.

Places and sequence numbers may be of any type that has an order. Regenerations are
taken from a conversation's messages in order, at the end.

Scale: events are numbered within a turn and folded by (conversation, message), so a
conversation that holds a third of all events is folded by many tasks; only its final
messages meet, as its rendering is one row of the output (and so must fit a row, 2 GB).

Defined cases: null texts and roles are empty; a null conv_id is a conversation
of its own; events of equal seq are ordered by kind, role and text; deltas and edits
of a message never opened are dropped; rows of ``conversations`` that share a turn
or are repeated are messages of their own, ordered by role and text; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table

HEAD, COLON, END = "### ", ": ", "</turn>\n"


def _replace(c: Column, *pairs: tuple[str, str]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


_TEXT = (("\\", "\\s"), ("###", "\\h"), ("</turn>", "\\t"))


def escape(c: Column) -> Column:
    return _replace(c, *_TEXT)


def unescape(c: Column) -> Column:
    return _replace(c, *((b, a) for a, b in reversed(_TEXT)))


def escape_role(c: Column) -> Column:
    return _replace(escape(c), (":", "\\c"))


def unescape_role(c: Column) -> Column:
    return unescape(_replace(c, ("\\c", ":")))


def as_events(conversations: DataFrame) -> DataFrame:
    """A log as a streaming client writes it.

    Every row opens a message and arrives in two deltas. A message of the assistant is
    first drafted backwards and regenerated; any other is first sent short and edited.
    A message's place is its turn with the number of its row among those of the turn, so
    that no more than a turn's rows are numbered together.
    """
    order = Window.partitionBy("conv_id", "turn").orderBy(F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = conversations.select("conv_id", "turn", F.row_number().over(order).alias("k"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    begun, rest = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))
    event = lambda k, kind, text: F.struct(F.lit(k).alias("step"), F.lit(kind).alias("kind"), text.alias("text"))
    none = F.lit("")
    drafted = F.array(event(0, "message", none), event(1, "delta", F.reverse("text")), event(2, "regenerate", none), event(3, "delta", begun), event(4, "delta", rest))
    sent = F.array(event(0, "message", begun), event(1, "edit", begun), event(2, "delta", rest))
    place = F.struct("turn", "k")
    return rows.select("conv_id", place.alias("msg"), "role", F.explode(F.when(F.col("role") == "assistant", drafted).otherwise(sent)).alias("e")).select(
        "conv_id", F.struct("msg.turn", "msg.k", "e.step").alias("seq"), "e.kind", "msg", "role", "e.text"
    )


def fold(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, msg, role, text."""
    event = F.struct("seq", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    opens = F.col("kind").isin("message", "regenerate")
    sets = F.col("kind").isin("message", "edit", "regenerate")
    messages = events.groupBy("conv_id", "msg").agg(
        F.array_sort(F.collect_list(event)).alias("events"),
        F.max(F.when(opens, F.col("seq"))).alias("opened"),
        F.max(F.when(sets, F.col("seq"))).alias("reset"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("again"),
    )
    before = Window.partitionBy("conv_id").orderBy("msg").rowsBetween(Window.unboundedPreceding, -1)
    alive = messages.withColumn("cut", F.max("again").over(before)).where("opened is not null and (cut is null or opened > cut)")
    # Of several setting events at the last such seq, the order of events decides: the last one's text begins.
    text = F.expr("""
        array_join(transform(
            slice(events, greatest(1, array_max(transform(events, (e, i) -> if(e.seq = reset and e.kind in ('message', 'edit', 'regenerate'), i + 1, 0)))), size(events)),
            e -> if(e.kind = 'regenerate', '', e.text)), '')""")
    role = F.expr("element_at(filter(events, e -> e.kind = 'message' or (e.kind = 'regenerate' and e.role <> '')), -1).role")
    return alive.select("conv_id", "msg", F.coalesce(role, F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, loss (array of start and stop) of each conversation."""
    head = F.concat(F.lit(HEAD), escape_role(F.col("role")), F.lit(COLON))
    pieces = messages.select("conv_id", "msg", "role", head.alias("head"), escape(F.col("text")).alias("body")).withColumn("piece", F.concat("head", "body", F.lit(END)))
    before = Window.partitionBy("conv_id").orderBy("msg").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("piece").cast("long")).over(before), F.lit(0)) + F.length("head")
    spans = pieces.withColumn("start", at).withColumn("stop", F.col("start") + F.length("body"))
    turn = F.struct("msg", "piece", (F.col("role") == "assistant").alias("loss"), "start", "stop")
    turns = spans.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return turns.select("conv_id", F.expr("array_join(transform(turns, t -> t.piece), '')").alias("formatted"), F.expr("transform(filter(turns, t -> t.loss), t -> named_struct('start', t.start, 'stop', t.stop))").alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), loss_text: the turns parsed from the rendering, and what is under the mask, unescaped."""
    cut = F.filter(F.split("formatted", END), lambda x: x != "")
    turns = F.transform(
        cut,
        lambda x: F.struct(
            unescape_role(F.substring_index(F.substr(x, F.lit(len(HEAD) + 1)), COLON, 1)).alias("role"),
            unescape(F.substr(x, F.instr(x, COLON) + len(COLON))).alias("text"),
        ),
    )
    masked = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int"))))
    return formatted.select("conv_id", turns.alias("turns"), F.array_join(masked, "").alias("loss_text"), "formatted")


def with_control_case(conversations: DataFrame) -> DataFrame:
    """Adds conversation -7, whose texts hold the template's own markers."""
    spark = conversations.sparkSession
    said = r"\\### Assistant: </turn> ok"
    return conversations.select("conv_id", "turn", "role", "text").unionByName(spark.sql(f"select -7L as conv_id, turn, role, '{said}' as text from values (0L, 'user'), (1L, 'assistant') as t(turn, role)"))


def op7_event_sourced_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = read_back(render(fold(as_events(with_control_case(read_table(spark, sf_dir, "conversations"))))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
with said as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), shown as (
  select *,
    replace(replace(replace(text, '\', '\s'), '###', '\h'), '</turn>', '\t') as body,
    replace(replace(replace(replace(role, '\', '\s'), '###', '\h'), '</turn>', '\t'), ':', '\c') as head
  from said
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(case when role = 'assistant' then length(text) end), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, role, text), '')) as loss_sha256,
  sum(4 + length(head) + 2 + length(body) + 8)::bigint as formatted_chars
from shown group by conv_id
"""
