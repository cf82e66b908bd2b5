"""Chat formatting: layouts recognised by a schema fingerprint, mapped to canonical turns, written with a reversible
template. DataFrame functions only.

A layout's fingerprint is the hash of its nested field paths. The fingerprint of a table's known paths (or of the paths
of each JSON record) selects a declarative mapping that turns it into canonical turns (role, text). Where the fields of
more than one layout stand together, the known paths are taken layout by layout, the largest first, and the first part
whose fingerprint is its layout's selects the mapping.

Template of a turn:  [INST]role[/INST]text</s>
Control strings inside roles and texts get a backslash after their first character; those that have backslashes there
already get one more, so unescaping takes one away and every text comes back as it was. The loss mask is a span
inside each assistant turn, in code points: it covers that turn's text and nothing of the template.

Cases: null texts are empty, null roles are empty strings; turns with equal numbers are ordered by role and text;
repeated rows are turns of their own; a null conv_id is a conversation; a very long text is one value of one row, whole;
other columns are ignored, whatever their names; an empty table gives an empty result; a JSON record that no layout fits
(or that is no JSON) has the layout UNKNOWN and no turns; a record's lists are judged by the fields of all their elements,
and an empty list fits its layout with no turns.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, SHUT, END = "[INST]", "[/INST]", "</s>"
_ESCAPE = r"([\[<])(\\*)(/?INST\]|/?s>)"
_UNESCAPE = r"([\[<])\\(\\*)(/?INST\]|/?s>)"

#: Layouts: the nested field paths that make them up, and SQL for their canonical turns: of one row, or, where a turn is a
#: row, of the rows of one key.
_TURNS = "transform({list}, m -> struct(coalesce(m.{role}, '') as role, coalesce(m.{text}, '') as text))"
_PAIR = "array(struct('user' as role, coalesce({ask}, '') as text), struct('assistant' as role, coalesce({answer}, '') as text))"
LAYOUTS: dict[str, tuple[tuple[str, ...], str]] = {
    "messages": (("messages", "messages.content", "messages.role"), _TURNS.format(list="messages", role="role", text="content")),
    "conversations": (("conversations", "conversations.from", "conversations.value"), "transform({0}, m -> struct(coalesce(element_at(map('human', 'user', 'gpt', 'assistant'), m.from), m.from, '') as role, coalesce(m.value, '') as text))".format("conversations")),
    "instruction": (("input", "instruction", "output"), _PAIR.format(ask="concat_ws('\\n', instruction, nullif(input, ''))", answer="output")),
    "instruction_only": (("instruction", "output"), _PAIR.format(ask="instruction", answer="output")),
    "prompt_completion": (("completion", "prompt"), _PAIR.format(ask="prompt", answer="completion")),
    "prompt_response": (("prompt", "response"), _PAIR.format(ask="prompt", answer="response")),
    "turn_rows": (("role", "text", "turn"), "transform(sort_array(collect_list(struct(turn, coalesce(role, '') as role, coalesce(text, '') as text))), m -> struct(m.role as role, m.text as text))"),
}
#: Layouts with a row for each turn.
GROUPED = ("turn_rows",)
UNKNOWN = "unknown"
_KNOWN = sorted({p for paths, _ in LAYOUTS.values() for p in paths})
_LARGEST_FIRST = sorted(LAYOUTS, key=lambda name: (-len(LAYOUTS[name][0]), name))


def paths_of(kind: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths of a type; lists are looked through."""
    if isinstance(kind, T.ArrayType):
        return paths_of(kind.elementType, prefix)
    if not isinstance(kind, T.StructType):
        return []
    return [p for f in kind.fields for p in (f"{prefix}{f.name}", *paths_of(f.dataType, f"{prefix}{f.name}."))]


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


FINGERPRINTS = {fingerprint(paths): name for name, (paths, _) in LAYOUTS.items()}


def table_layout(df: DataFrame) -> str:
    """The layout that the fingerprint of a table's known paths selects. Unknown columns don't matter."""
    paths = set(paths_of(df.schema))
    parts = [paths & set(_KNOWN), *(paths & set(LAYOUTS[name][0]) for name in _LARGEST_FIRST)]
    for part in parts:
        if fingerprint(part) in FINGERPRINTS:
            return FINGERPRINTS[fingerprint(part)]
    raise ValueError(f"no layout has the field paths {sorted(paths)}")


def canonical(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, turns: array<struct<role, text>> for any known layout."""
    name = table_layout(df)
    turns = F.expr(LAYOUTS[name][1]).alias("turns")
    return df.groupBy(key).agg(turns) if name in GROUPED else df.select(key, turns)


def canonical_json(df: DataFrame, key: str = "conv_id", column: str = "record") -> DataFrame:
    """key, layout, turns for JSON records of any layouts; the fingerprint of each record's known paths selects the mapping."""
    single = {name: v for name, v in LAYOUTS.items() if name not in GROUPED}
    top = F.coalesce(F.json_object_keys(column), F.array().cast("array<string>"))

    def inner(list_: str) -> Column:
        """The paths within a list, over all its elements; of an empty list those of its layout."""
        elements = F.from_json(F.get_json_object(column, f"$.{list_}"), "array<map<string,string>>")
        keys = F.array_distinct(F.flatten(F.transform(F.filter(elements, lambda m: m.isNotNull()), F.map_keys)))
        own = F.array(*(F.lit(p) for p in _KNOWN if p.startswith(f"{list_}.")))
        found = F.when(F.size(elements) == 0, own).otherwise(F.transform(keys, lambda k: F.concat(F.lit(f"{list_}."), k)))
        return F.coalesce(found, F.array().cast("array<string>"))

    def selected(fields: list[str]) -> Column:
        part = F.filter("paths", lambda p: p.isin(fields))
        prints = F.create_map(*(F.lit(v) for pair in FINGERPRINTS.items() if pair[1] in single for v in pair))
        return F.element_at(prints, F.sha2(F.array_join(F.sort_array(part), "\n"), 256))

    rows = df.select(key, column, F.concat(top, inner("messages"), inner("conversations")).alias("paths"))
    fields = sorted({p for paths, _ in single.values() for p in paths})
    layout = F.coalesce(selected(fields), *(selected(list(single[name][0])) for name in _LARGEST_FIRST if name in single), F.lit(UNKNOWN))
    rows = rows.select(key, column, layout.alias("layout"))
    schema = "messages array<struct<role:string,content:string>>, conversations array<struct<`from`:string,value:string>>, instruction string, input string, output string, prompt string, completion string, response string"
    rows = rows.select(key, "layout", F.from_json(column, schema).alias("r")).select(key, "layout", "r.*")
    none = F.array().cast("array<struct<role:string,text:string>>")
    turns = None
    for name, (_, sql) in single.items():
        turns = F.when(F.col("layout") == name, F.expr(sql)) if turns is None else turns.when(F.col("layout") == name, F.expr(sql))
    return rows.select(key, "layout", F.coalesce(turns, none).alias("turns"))


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2$3")


def formatted(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, formatted, loss_mask: array<struct<turn, start, length>>, spans inside the turns in code points."""
    one = lambda m: F.concat(F.lit(OPEN), escaped(m["role"]), F.lit(SHUT), escaped(m["text"]), F.lit(END))
    spans = F.transform(
        "turns",
        lambda m, i: F.when(
            m["role"] == "assistant",
            F.struct(i.alias("turn"), (F.length(escaped(m["role"])) + len(OPEN) + len(SHUT)).alias("start"), F.length(escaped(m["text"])).alias("length")),
        ),
    )
    return conversations.select(key, F.array_join(F.transform("turns", one), "").alias("formatted"), F.array_compact(spans).alias("loss_mask"))


def read_back(output: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, turns and loss_text from formatted conversations and their loss masks alone."""
    pieces = F.split("formatted", f"(?<={END})")
    rows = output.select(key, "formatted", "loss_mask", F.filter(pieces, lambda p: p != "").alias("_p"))
    body = lambda p: F.left(p, F.length(p) - len(END))

    def turn(p: Column) -> Column:
        rest = F.substr(body(p), F.lit(len(OPEN) + 1))
        cut = F.instr(rest, SHUT)
        return F.struct(unescaped(F.left(rest, cut - 1)).alias("role"), unescaped(F.substr(rest, cut + len(SHUT))).alias("text"))

    loss = F.transform("loss_mask", lambda s: unescaped(F.substr(F.get(F.col("_p"), s["turn"]), s["start"] + 1, s["length"])))
    return rows.select(key, "formatted", F.transform("_p", turn).alias("turns"), F.array_join(loss, "").alias("loss_text"))


def digests(back: DataFrame, key: str = "conv_id") -> DataFrame:
    lines = F.transform("turns", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n")))
    return back.select(
        key,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
