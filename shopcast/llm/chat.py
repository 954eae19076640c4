"""Chat formatting: schema fingerprints select declarative mappings into canonical turns.

A record is a variant of any layout.  Its nested field names (scalar types
dropped) are hashed; the hash selects a mapping that says where roles and
texts lie.  A record of no such hash still takes a mapping with a list if it
has that list, whatever other fields stand beside it or in its messages, as
long as no other mapping reads them.  Records of fixed fields have no such
mark: there an unknown field may be part of the talk, so the layout is unknown.  Canonical turns are rendered with a template whose control strings
are escaped inside texts, reversibly, and can be read back from the output
alone.  DataFrame functions only.

Template: ``<s>``, then per turn ``[INST] role\\ntext [/INST]`` or, for the
assistant, ``text</s>``.  Inside roles and texts ``\\`` becomes ``\\z`` and a
``\\c`` goes behind the first character of ``<s> </s> [INST] [/INST]``; in
roles a line feed becomes ``\\n``.

Defined results: null roles and texts are empty; an unknown layout has null
turns and the layout name ``unknown``; a record without turns (its list is
empty or null) formats to ``<s>``, its layout is the first with that list; rows of one conversation and turn are ordered by role, then text.
One conversation is one output row, so its own length bounds the grouping.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<role:string,text:string>>"
ASSISTANT = "assistant"
OPEN, CLOSE, BEGIN, END = "[INST] ", " [/INST]", "<s>", "</s>"


@dataclass(frozen=True)
class Mapping:
    """A layout (field tree) and where its turns are: a list of messages, or fixed (role, fields) parts."""
    name: str
    layout: dict
    messages: tuple[str, str, str] | None = None        # list field, role field, text field
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()  # role, fields joined by a blank line


# Layouts in common use.
MAPPINGS = (
    Mapping("messages_text", {"messages": [{"role": "", "text": ""}]}, ("messages", "role", "text")),
    Mapping("messages_content", {"messages": [{"role": "", "content": ""}]}, ("messages", "role", "content")),
    Mapping("conversations_from", {"conversations": [{"from": "", "value": ""}]}, ("conversations", "from", "value")),
    Mapping("prompt_response", {"prompt": "", "response": ""},
            parts=(("user", ("prompt",)), (ASSISTANT, ("response",)))),
    Mapping("prompt_completion", {"prompt": "", "completion": ""},
            parts=(("user", ("prompt",)), (ASSISTANT, ("completion",)))),
    Mapping("instruction_output", {"instruction": "", "output": ""},
            parts=(("user", ("instruction",)), (ASSISTANT, ("output",)))),
    Mapping("instruction_input_output", {"instruction": "", "input": "", "output": ""},
            parts=(("user", ("instruction", "input")), (ASSISTANT, ("output",)))),
    Mapping("system_prompt_response", {"system": "", "prompt": "", "response": ""},
            parts=(("system", ("system",)), ("user", ("prompt",)), (ASSISTANT, ("response",)))),
)
# Role names that mean a canonical one.
ROLE_NAMES = {"human": "user", "gpt": ASSISTANT, "bot": ASSISTANT}


def signature(layout) -> str:
    """Field tree in the notation of ``schema_of_variant``, scalar types left out, names sorted."""
    if isinstance(layout, dict):
        inner = ", ".join(k if v == "" else f"{k}: {signature(v)}" for k, v in sorted(layout.items()))
        return f"OBJECT<{inner}>"
    return f"ARRAY<{signature(layout[0])}>"


def fingerprint_of(layout) -> str:
    return hashlib.sha256(signature(layout).encode()).hexdigest()[:16]


def fingerprint(record: Column) -> Column:
    """Hash of a variant's nested field names."""
    paths = F.regexp_replace(F.schema_of_variant(record), r": (?!OBJECT<|ARRAY<)[A-Z_]+(\([0-9, ]+\))?", "")
    return F.substring(F.sha2(paths, 256), 1, 16)


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _turns(record: Column, m: Mapping) -> Column:
    if m.messages:
        field, role, text = m.messages
        rows = F.variant_get(record, f"$.{field}", f"array<struct<`{role}`:string,`{text}`:string>>")

        def turn(x: Column) -> Column:
            name = _text(x[role])
            if role == "from":
                name = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in ROLE_NAMES.items() for v in kv]), name), name)
            return F.struct(name.alias("role"), _text(x[text]).alias("text"))
        return F.transform(rows, turn)

    def part(fields: tuple[str, ...]) -> Column:
        values = [F.try_variant_get(record, f"$.{f}", "string") for f in fields]
        return _text(values[0]) if len(values) == 1 else F.concat_ws("\n\n", *[F.nullif(v, F.lit("")) for v in values])
    return F.array(*[F.struct(F.lit(role).alias("role"), part(fields).alias("text")) for role, fields in m.parts])


def _listed(record: Column, m: Mapping, mappings: tuple[Mapping, ...]) -> tuple[Column, Column]:
    """Whether the record holds the mapping's list among other fields, and whether that list is empty or null.

    Fields that no mapping reads are ignored; those that another one reads may be part of the talk, so they are not.
    """
    field, role, text = m.messages
    read = {x.messages[0] for x in mappings if x.messages} | {f for x in mappings for _, fs in x.parts for f in fs}
    tops = sorted(read - {field})
    inner = sorted({n for x in mappings if x.messages for n in x.messages[1:]} - {role, text})

    def at(v: Column, name: str) -> Column:
        return F.try_variant_get(v, f"$.{name}", "variant")

    def without(v: Column, names: list[str]) -> Column:
        return reduce(lambda a, n: a & at(v, n).isNull(), names, F.lit(True))

    def plain(v: Column) -> Column:
        return ~F.coalesce(F.schema_of_variant(v), F.lit("VOID")).rlike("^(OBJECT|ARRAY)<")

    def fits(x: Column) -> Column:
        shaped = F.schema_of_variant(x).startswith("OBJECT<") & plain(at(x, role)) & plain(at(x, text)) & without(x, inner)
        return x.isNull() | F.is_variant_null(x) | shaped
    rows = F.try_variant_get(record, f"$.{field}", "array<variant>")
    alone = without(record, tops)
    full = F.forall(rows, fits) & F.exists(rows, lambda x: at(x, role).isNotNull()) & F.exists(rows, lambda x: at(x, text).isNotNull())
    empty = F.is_variant_null(at(record, field)) | (F.size(rows) == 0)
    return F.coalesce(alone & full, F.lit(False)), F.coalesce(alone & at(record, field).isNotNull() & empty, F.lit(False))


def canonical_turns(df: DataFrame, record: str, turns: str = "turns", layout: str = "layout",
                    mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Add the layout's name and the canonical turns of a variant column."""
    mark, r = fingerprint(F.col(record)), F.col(record)
    name, body = F.lit("unknown"), F.lit(None).cast(TURNS)
    for m in reversed([m for m in mappings if m.messages]):
        full, empty = _listed(r, m, mappings)
        name = F.when(full | empty, F.lit(m.name)).otherwise(name)
        body = F.when(full, _turns(r, m)).when(empty, F.array().cast(TURNS)).otherwise(body)
    for m in reversed(mappings):
        hit = mark == F.lit(fingerprint_of(m.layout))
        name, body = F.when(hit, F.lit(m.name)).otherwise(name), F.when(hit, _turns(r, m)).otherwise(body)
    return df.withColumn(layout, name).withColumn(turns, body)


def escape(c: Column, role: bool = False) -> Column:
    c = F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("\\z")), r"([<\[])(/?)(s>|INST\])", r"$1\\c$2$3")
    return F.replace(c, F.lit("\n"), F.lit("\\n")) if role else c


def unescape(c: Column, role: bool = False) -> Column:
    c = F.replace(c, F.lit("\\c"), F.lit(""))
    c = F.replace(c, F.lit("\\n"), F.lit("\n")) if role else c
    return F.replace(c, F.lit("\\z"), F.lit("\\"))


def render(turns: Column) -> Column:
    """Canonical turns -> one training string."""
    def one(t: Column) -> Column:
        asked = F.concat(F.lit(OPEN), escape(t["role"], True), F.lit("\n"), escape(t["text"]), F.lit(CLOSE))
        return F.when(t["role"] == ASSISTANT, F.concat(escape(t["text"]), F.lit(END))).otherwise(asked)
    return F.concat(F.lit(BEGIN), F.array_join(F.transform(turns, one), ""))


def loss_mask(turns: Column) -> Column:
    """Run lengths over the rendered string in code points, by turns without and with loss (first without)."""
    def one(t: Column) -> Column:
        body = F.char_length(escape(t["text"]))
        other = F.char_length(escape(t["role"], True)) + body + (len(OPEN) + 1 + len(CLOSE))
        return F.when(t["role"] == ASSISTANT, F.array(F.lit(0), body, F.lit(len(END)), F.lit(0))).otherwise(
            F.array(other, F.lit(0), F.lit(0), F.lit(0)))
    return F.concat(F.array(F.lit(len(BEGIN)), F.lit(0)), F.flatten(F.transform(turns, one)))


def read_back(formatted: Column) -> Column:
    """The turns of a rendered string, from the string alone."""
    body = F.substr(formatted, F.lit(len(BEGIN) + 1))
    pieces = F.split(body, r"(?<=</s>)|(?<=\[/INST\])", -1)

    def one(p: Column) -> Column:
        inner = F.substr(p, F.lit(len(OPEN) + 1), F.char_length(p) - (len(OPEN) + len(CLOSE)))
        cut_at = F.locate("\n", inner)
        said = F.struct(F.lit(ASSISTANT).alias("role"), unescape(F.substr(p, F.lit(1), F.char_length(p) - len(END))).alias("text"))
        asked = F.struct(unescape(F.substr(inner, F.lit(1), cut_at - 1), True).alias("role"),
                         unescape(F.substr(inner, cut_at + 1)).alias("text"))
        return F.when(F.endswith(p, F.lit(END)), said).otherwise(asked)
    return F.transform(F.filter(pieces, lambda p: p != ""), one)


def records_of(rows: DataFrame) -> DataFrame:
    """Rows by turn (conv_id, turn, role, text) -> one variant record a conversation."""
    turn = F.struct("turn", _text(F.col("role")).alias("role"), _text(F.col("text")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("m"))
    messages = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return grouped.select("conv_id", F.to_variant_object(F.struct(messages.alias("messages"))).alias("record"))


def format_chats(records: DataFrame, record: str = "record") -> DataFrame:
    """Add layout, turns, the rendered string and its loss mask."""
    t = canonical_turns(records, record)
    return t.withColumn("formatted", render(F.col("turns"))).withColumn("loss_mask", loss_mask(F.col("turns")))


def under_mask(formatted: Column, mask: Column) -> Column:
    """The stretches of the rendered string that the mask gives loss, unescaped, in order."""
    def step(state: Column, i: Column) -> Column:
        begin = state["at"] + F.get(mask, 2 * i)
        size = F.get(mask, 2 * i + 1)
        said = F.when(size > 0, F.concat(state["said"], F.array(unescape(F.substr(formatted, begin + 1, size))))).otherwise(state["said"])
        return F.struct((begin + size).alias("at"), said.alias("said"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("said"))
    return F.aggregate(F.sequence(F.lit(0), F.floor(F.size(mask) / 2).cast("int") - 1), start, step)["said"]


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, what the rendered string says when read back, and what lies under its loss mask."""
    back = formatted.withColumn("back", read_back(F.col("formatted")))
    said = under_mask(F.col("formatted"), F.col("loss_mask"))
    whole = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(said, "")
    return back.select("conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
                       F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                       F.char_length("formatted").cast("long").alias("formatted_chars"), "layout")
