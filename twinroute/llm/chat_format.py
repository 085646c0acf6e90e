"""Chat formatting: a finite-state machine over roles and a declarative template.

A conversation's turns are ordered, checked by the machine and rendered as text segments
with a loss flag each; the training text is the segments joined.  Control strings inside
roles and texts are escaped reversibly, so the formatted text can be parsed back into the
same turns.  Only DataFrame expressions are used; one shuffle brings the turns of a
conversation together, which is the unit of the output.

Defined results: a null role or text counts as empty; turns order by (turn, role, text),
null first, so ties and repeated rows have one order; rows with a null ``conv_id`` form one
conversation; a conversation that breaks the turn order is still formatted and has
``valid`` false with the number of the first turn at fault; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """Marks, roles under the loss and the turn order of a chat format."""

    begin: str = "<s>"
    end: str = "</s>"
    turn: str = "<|turn|>"
    text: str = "<|text|>"
    stop: str = "<|end|>"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: Strings that a text must not hold unescaped, besides the marks above.
    reserved: tuple[str, ...] = ("[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|im_start|>", "<|im_end|>")
    start: str = "start"
    #: state -> role -> next state
    moves: Mapping[str, Mapping[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "system", "user": "user"},
            "system": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user"},
        }
    )
    accept: tuple[str, ...] = ("assistant",)

    def controls(self) -> tuple[str, ...]:
        return (self.begin, self.end, self.turn, self.text, self.stop, *self.reserved)


def escape(text: Column, template: Template) -> Column:
    """Doubles escape characters, then parts the first character of every control string from its rest."""
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for c in template.controls():
        out = F.replace(out, F.lit(c), F.lit(c[0] + ESCAPE + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def machine(turns: Column, template: Template) -> Column:
    """struct(state, bad): the state after all turns, and the place (from 0) of the first turn without a move."""
    moves = [F.lit(x) for s, by in template.moves.items() for r, to in by.items() for x in (f"{s}\n{r}", to)]
    table_of = F.create_map(*moves)

    def step(a: Column, t: Column) -> Column:
        to = F.when(a["bad"] < 0, F.try_element_at(table_of, F.concat(a["state"], F.lit("\n"), t["role"])))
        return F.struct(
            F.coalesce(to, a["state"]).alias("state"),
            F.when((a["bad"] < 0) & to.isNull(), a["at"]).otherwise(a["bad"]).alias("bad"),
            (a["at"] + 1).alias("at"),
        )

    begin = F.struct(F.lit(template.start).alias("state"), F.lit(-1).alias("bad"), F.lit(0).alias("at"))
    return F.aggregate(turns, begin, step)


def format_chats(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, formatted, segments (text, loss), n_turns, valid and bad_turn of every conversation."""
    row = F.struct(F.col("turn").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))

    def rendered(t: Column) -> Column:
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        no = F.lit(False)
        return F.array(
            part(F.concat(F.lit(template.turn), escape(t["role"], template), F.lit(template.text)), no),
            part(escape(t["text"], template), t["role"].isin(*template.loss_roles)),
            part(F.lit(template.stop), no),
        )

    parts = whole.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        machine(F.col("turns"), template).alias("m"),
        F.flatten(F.transform("turns", rendered)).alias("segments"),
    )
    joined = F.concat(F.lit(template.begin), F.array_join(F.col("segments.text"), ""), F.lit(template.end))
    return parts.select(
        "conv_id",
        joined.alias("formatted"),
        "segments",
        "n_turns",
        ((F.col("m.bad") < 0) & F.col("m.state").isin(*template.accept)).alias("valid"),
        F.when(F.col("m.bad") >= 0, F.col("m.bad")).alias("bad_turn"),
    )


def parse(formatted: Column, template: Template = Template()) -> Column:
    """The turns (role, text) that a formatted text holds."""
    quoted = lambda s: "\\Q" + s + "\\E"
    inner = F.substring(formatted, F.lit(len(template.begin) + 1), F.length(formatted) - len(template.begin) - len(template.end))
    pieces = F.split(inner, quoted(template.turn))

    def turn(p: Column) -> Column:
        both = F.split(p, quoted(template.text))
        text = F.split(F.get(both, F.lit(1)), quoted(template.stop))
        return F.struct(unescape(F.get(both, F.lit(0))).alias("role"), unescape(F.get(text, F.lit(0))).alias("text"))

    return F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), turn)


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -7: a user and an assistant row that both say control strings."""
    return spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    out = format_chats(said.unionByName(probe(spark)))
    read = out.select(
        "conv_id",
        parse(F.col("formatted")).alias("turns"),
        F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "").alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "valid",
    )


def _escaped_sql(column: str, template: Template = Template()) -> str:
    out = f"replace({column}, '{ESCAPE}', '{ESCAPE * 2}')"
    for c in template.controls():
        out = f"replace({out}, '{c}', '{c[0]}{ESCAPE}{c[1:]}')"
    return out


_T = Template()
ORACLE = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (SELECT *, row_number() OVER w AS k, lag(role) OVER w AS before FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
g AS (SELECT conv_id, count(*) AS n_turns,
  string_agg(role || chr(10) || text || chr(10), '' ORDER BY k) AS turns,
  coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '') AS loss,
  sum(length({_escaped_sql("role")}) + length({_escaped_sql("text")}) + {len(_T.turn) + len(_T.text) + len(_T.stop)}) + {len(_T.begin) + len(_T.end)} AS formatted_chars,
  bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before IN ('system', 'assistant') THEN role = 'user' ELSE before = 'user' AND role = 'assistant' END)
    AND max_by(role, k) = 'assistant' AS valid
  FROM o GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars, valid FROM g
"""
