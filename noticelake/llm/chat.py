"""Operator 1: heterogeneous chat records to canonical turns and one template.

The nested field paths that a row fills in are hashed to a fingerprint; the
fingerprint selects a declarative mapping, which turns prompt, instruction or
message layouts into an array of (role, text) turns. The template writes the turns
between markers, escapes control strings inside roles and texts so that they can be
read back, and gives the stretches of assistant text as the loss mask.

Defined results: a null text or role is an empty one; turns of equal number are in
order of role, then text; repeated rows are repeated turns; rows without a
conversation id form one conversation with a null id; a row whose fingerprint no
mapping knows keeps its row with no turns, the status ``unknown`` and its fingerprint, so
that it can be set aside and mapped later, see ``unmapped``; a row none of whose known
fields is filled has the status ``empty``; other rows are ``mapped``; an empty system text
is a turn of its own; columns that no layout names are ignored; empty tables give empty
results; columns of the input that have a result's name are replaced.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticelake.llm.common import fresh

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
TRAINED_ROLE = "assistant"
#: The first character of every string that a chat template may take for a control.
CONTROL = r"(<(?=/?s>|<?/?SYS>|\|)|\[(?=/?INST\]))"
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """The field paths of a record, [] for an array's elements, and how its turns are built.

    Each step is (role or path of the role, path of the text); ``over`` names the array that it walks,
    ``optional`` a text that follows the user's, ``lead`` the text of a system turn before all others.
    """

    paths: tuple[str, ...]
    steps: tuple[tuple[str, str], ...]
    over: str = ""
    optional: str = ""
    lead: str = ""


#: What common layouts look like. Roles in quotation marks are constants.
PLAIN_LAYOUTS = (
    Layout(("messages[].content", "messages[].role"), (("role", "content"),), over="messages"),
    Layout(("conversations[].from", "conversations[].value"), (("from", "value"),), over="conversations"),
    Layout(("completion", "prompt"), (("'user'", "prompt"), ("'assistant'", "completion"))),
    Layout(("prompt", "response"), (("'user'", "prompt"), ("'assistant'", "response"))),
    Layout(("answer", "question"), (("'user'", "question"), ("'assistant'", "answer"))),
    Layout(("instruction", "response"), (("'user'", "instruction"), ("'assistant'", "response"))),
    Layout(("instruction", "output"), (("'user'", "instruction"), ("'assistant'", "output"))),
    Layout(("input", "instruction", "output"), (("'user'", "instruction"), ("'assistant'", "output")), optional="input"),
    Layout(("input", "output"), (("'user'", "input"), ("'assistant'", "output"))),
)
#: Each of them also comes with a system text.
LAYOUTS = PLAIN_LAYOUTS + tuple(replace(x, paths=tuple(sorted((*x.paths, "system"))), lead="system") for x in PLAIN_LAYOUTS)
#: Names of other makers for the three roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """All leaf paths of a schema."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [at]


def fingerprint(paths: tuple[str, ...] | list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def row_fingerprint(df: DataFrame) -> Column:
    """Per row, the fingerprint of the known field paths whose top field is not null."""
    known = {p for layout in LAYOUTS for p in layout.paths}
    paths = sorted(p for p in field_paths(df.schema) if p in known)
    if not paths:
        return F.lit(fingerprint(()))
    top = lambda p: F.col(p.split("[]")[0].split(".")[0])
    return F.sha2(F.concat_ws("\n", *(F.when(top(p).isNotNull(), F.lit(p)) for p in paths)), 256)


def _turns(layout: Layout) -> Column:
    empty = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    turn = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    lead = [turn(F.lit("system"), empty(F.col(layout.lead)))] if layout.lead else []
    if layout.over:
        (role, text) = layout.steps[0]
        listed = F.transform(F.col(layout.over), lambda m: turn(empty(m[role]), empty(m[text])))
        return F.concat(F.array(*lead), listed) if lead else listed
    made = lead
    for role, path in layout.steps:
        text = empty(F.col(path))
        if layout.optional and role == "'user'":
            extra = empty(F.col(layout.optional))
            text = F.when(extra == "", text).otherwise(F.concat(text, F.lit("\n\n"), extra))
        made.append(turn(F.lit(role.strip("'")), text))
    return F.array(*made)


def canonical_turns(df: DataFrame, out: str = "turns", status: str = "status", fingerprint_col: str = "fingerprint") -> DataFrame:
    """``df`` with the turns that the mapping of each row's fingerprint gives, the fingerprint, and whether it is known."""
    have = set(field_paths(df.schema))
    chosen = F.lit(None).cast(TURNS)
    print_ = row_fingerprint(df)
    for layout in LAYOUTS:
        if set(layout.paths) <= have:
            chosen = F.when(print_ == fingerprint(layout.paths), _turns(layout)).otherwise(chosen)
    known = [fingerprint(x.paths) for x in LAYOUTS if set(x.paths) <= have]
    state = F.when(print_.isin(known), "mapped").when(print_ == fingerprint(()), "empty").otherwise("unknown")
    turns = F.coalesce(chosen, F.array().cast(TURNS))
    role = lambda r: F.coalesce(*(F.when(r == k, F.lit(v)) for k, v in ROLES.items()), r)
    renamed = F.transform(turns, lambda t: F.struct(role(t["role"]).alias("role"), t["text"].alias("text")))
    return df.withColumns({out: renamed, status: state, fingerprint_col: print_})


def unmapped(df: DataFrame) -> DataFrame:
    """The rows of ``df`` that no mapping knows, with their fingerprint: what is to be set aside and mapped by a new layout."""
    status, print_ = fresh(df, "status", "fingerprint")
    return canonical_turns(df, fresh(df, "turns")[0], status, print_).filter(F.col(status) == "unknown").select(*[F.col(f"`{c}`") for c in df.columns], print_)


def gather_turns(rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Rows by turn (id, turn, role, text) to one record with ``messages`` per conversation."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    gathered = rows.select(F.col(id_col).alias("conv_id"), turn.alias("turn")).groupBy("conv_id")
    return gathered.agg(F.array_sort(F.collect_list("turn")).alias("found")).select(
        "conv_id",
        F.transform("found", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages"),
    )


def escape(text: Column) -> Column:
    """Double backslashes, then break each control string after its first character."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(df: DataFrame, turns: str = "turns") -> DataFrame:
    """``df`` with ``formatted`` and ``loss_mask``, an array of (start, end) in code points."""
    written = F.transform(
        F.col(turns), lambda t: F.struct(t["role"].alias("role"), escape(t["role"]).alias("r"), escape(t["text"]).alias("t"))
    )
    parts = df.withColumn("__written", written)
    frame = len(TURN) + len(TEXT)
    step = lambda w: F.length(w["r"]) + F.length(w["t"]) + F.lit(frame + len(END))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def place(state: Column, w: Column) -> Column:
        begin = state["at"] + F.length(w["r"]) + F.lit(frame)
        span = F.array(F.struct(begin.alias("start"), (begin + F.length(w["t"])).alias("end")))
        spans = F.when(w["role"] == TRAINED_ROLE, F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct((state["at"] + step(w)).alias("at"), spans.alias("spans"))

    one = lambda w: F.concat(F.lit(TURN), w["r"], F.lit(TEXT), w["t"], F.lit(END))
    return parts.select(
        *df.columns,
        F.array_join(F.transform("__written", one), "").alias("formatted"),
        F.aggregate("__written", start, place)["spans"].alias("loss_mask"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation."""
    cut = F.slice(F.split(formatted, r"<\|turn\|>"), 2, 1 << 30)
    part = lambda t: F.split(t, r"<\|(?:text|end)\|>")
    return F.transform(cut, lambda t: F.struct(unescape(part(t)[0]).alias("role"), unescape(part(t)[1]).alias("text")))


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def chat_report(records: DataFrame) -> DataFrame:
    """Per conversation the digests of what is read back from its formatted text."""
    done = format_turns(canonical_turns(records).select("conv_id", "turns", "status", "fingerprint"))
    back = read_back(F.col("formatted"))
    spoken = F.array_join(F.transform(back, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = masked_text(F.col("formatted"), F.col("loss_mask"))
    return done.select(
        "conv_id",
        F.size(back).cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "status",
        "fingerprint",
    )
