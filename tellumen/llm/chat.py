"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame functions only.

A template maps each role to a prefix, a suffix and a loss flag. Texts are escaped so that no control string
of the template can occur inside them, and the escape is reversible, so the formatted string can be read back; so
are roles without an entry, in which the separator after the role is escaped too.

Defined results: null text is empty; null roles are formatted with the fallback entry and make the
conversation invalid; rows of a conversation are ordered by (turn, role, text), so ties and repeated rows have
one result; rows with a null conv_id form one conversation, a null role reads back as empty; an empty table gives
no rows; extra columns are ignored. One conversation is one output string, so its size is bounded by its own texts.
The query's conversation -7 takes in rows that the table itself has under that number.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellumen.llm.common import table


@dataclass(frozen=True)
class Template:
    """`opening` + role + `after_role` + escaped text + `closing`, per turn. `loss_roles` carry the loss flag."""

    opening: str = "### "
    after_role: str = ": "
    closing: str = " </turn>\n"
    names: dict = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    loss_roles: tuple = ("assistant",)
    #: control string -> code after the escape character; the escape character itself comes first.
    escapes: tuple = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t"))
    #: state -> roles that may come next and the state they lead to.
    machine: dict = field(default_factory=lambda: {
        "start": {"system": "primed", "user": "asked"},
        "primed": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    })
    accepting: tuple = ("answered",)


def escape(text: Column, t: Template) -> Column:
    for what, code in t.escapes:
        text = F.replace(text, F.lit(what), F.lit(code))
    return text


def unescape(text: Column, t: Template) -> Column:
    for what, code in reversed(t.escapes):
        text = F.replace(text, F.lit(code), F.lit(what))
    return text


def _separator(t: Template) -> tuple[str, str]:
    """What ends a name, and its code inside names, so that a name ends at the first separator."""
    return t.after_role.strip() or t.after_role, "\\c"


def _name(role: Column, t: Template) -> Column:
    out = None
    for k, v in t.names.items():
        out = F.when(role == k, v) if out is None else out.when(role == k, v)
    what, code = _separator(t)
    return out.otherwise(F.concat(F.lit("?"), F.replace(escape(F.coalesce(role, F.lit("")), t), F.lit(what), F.lit(code))))


def _role(name: Column, t: Template) -> Column:
    out = None
    for k, v in t.names.items():
        out = F.when(name == v, k) if out is None else out.when(name == v, k)
    what, code = _separator(t)
    return out.otherwise(unescape(F.replace(F.substr(name, F.lit(2)), F.lit(code), F.lit(what)), t))


def _step(state: Column, role: Column, t: Template) -> Column:
    out = None
    for at, moves in t.machine.items():
        for r, to in moves.items():
            cond = (state == at) & (role == r)
            out = F.when(cond, F.lit(to)) if out is None else out.when(cond, F.lit(to))
    return out.otherwise(F.lit("rejected"))


def format_conversations(rows: DataFrame, t: Template | None = None) -> DataFrame:
    """One row per conversation: conv_id, formatted, segments array<struct<text, loss>>, valid, final_state,
    n_turns. Segments concatenate to `formatted`; a true loss flag covers exactly the escaped text of a turn."""
    t = t or Template()
    turn = F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    g = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def segments(x: Column) -> Column:
        head = F.concat(F.lit(t.opening), _name(x["role"], t), F.lit(t.after_role))
        loss = F.coalesce(x["role"].isin(*t.loss_roles), F.lit(False))
        seg = lambda text, flag: F.struct(text.alias("text"), flag.alias("loss"))
        return F.array(seg(head, F.lit(False)), seg(escape(x["text"], t), loss), seg(F.lit(t.closing), F.lit(False)))

    state = F.aggregate("turns", F.lit("start"), lambda s, x: _step(s, F.coalesce(x["role"], F.lit("")), t))
    g = g.select("conv_id", F.size("turns").cast("long").alias("n_turns"), state.alias("final_state"), F.flatten(F.transform("turns", segments)).alias("segments"))
    return g.select(
        "conv_id",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "segments",
        F.col("final_state").isin(*t.accepting).alias("valid"),
        "final_state",
        "n_turns",
    )


def read_back(formatted: Column, t: Template | None = None) -> Column:
    """array<struct<role, text>> parsed from a formatted string."""
    t = t or Template()
    quoted = "".join("\\" + c if not c.isalnum() and c not in " \n" else c for c in t.closing)
    turns = F.filter(F.split(formatted, quoted, -1), lambda x: x != "")

    def parse(x: Column) -> Column:
        body = F.substr(x, F.lit(len(t.opening) + 1))
        cut = F.instr(body, t.after_role)
        return F.struct(
            _role(F.substr(body, F.lit(1), cut - 1), t).alias("role"),
            unescape(F.substr(body, cut + len(t.after_role)), t).alias("text"),
        )

    return F.transform(turns, parse)


def op7_chat_formatting(spark, sf_dir: str) -> DataFrame:
    t = Template()
    tricky = "\\### Assistant: </turn> ok"
    extra = spark.sql("SELECT -7L AS conv_id, id AS turn, CASE id WHEN 0 THEN 'user' ELSE 'assistant' END AS role FROM range(0, 2, 1, 1)").withColumn("text", F.lit(tricky))
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    out = format_conversations(rows.unionByName(extra), t)
    back = read_back(F.col("formatted"), t)
    lost = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], t)), "")
    said = F.array_join(F.transform("back", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    out = out.withColumns({"back": back, "lost": lost})
    return out.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("lost").cast("long").alias("loss_chars"),
        F.sha2("lost", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


#: The same digests from the rows themselves; the length of the output from the template's parts.
OP7_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t') AS esc,
        lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS prev,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS from_end FROM r),
f AS (SELECT *, CASE WHEN prev IS NULL THEN role IN ('system', 'user') WHEN prev IN ('system', 'assistant') THEN role = 'user'
        ELSE role = 'assistant' END AND (from_end > 1 OR role = 'assistant') AS fine FROM e)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(length('### ') + length(role) + length(': ') + length(esc) + length(' </turn>') + 1)::BIGINT AS formatted_chars,
  bool_and(fine) AS valid
FROM f GROUP BY conv_id
"""
