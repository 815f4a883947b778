"""Chat formatting: heterogeneous layouts -> canonical turns -> one marked-up string with a loss mask.

A record's layout is found by its **schema fingerprint**: the SHA-256 of the sorted nested field paths it has,
out of the paths the layouts name. The fingerprint selects one declarative mapping (`LAYOUTS`). A typed frame
has one fingerprint, from its schema; a column of JSON records has one for each row, from the paths that are
present in it. Paths no layout names do not count, so extra fields never change a layout. Everything is SQL
expressions: no Python touches a row.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. Escaping inserts one backslash between ``<``
and ``|`` (after the backslashes already there), so no text or role can hold a control string and unescaping
takes exactly one out again. A line feed in a role is written ``<|nl|>``, which no escaped role can hold.

Defined results: a null text or role is empty; a null turn sorts before the others; ties in ``turn`` are ordered
by role and text; repeated rows are turns of their own. A conversation is one row of the result, as its string
must be; rows with a null conversation id form one conversation. Records with an unknown layout give no turns and
come out of `json_turns` with layout null. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The control strings of the template.
START, END, NEWLINE = "<|im_start|>", "<|im_end|>\n", "<|nl|>"
TURN = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """``paths``: nested fields that make the layout (``[]`` for an array's elements).
    ``turns``: from a getter for such a path to an array of (role, text)."""

    name: str
    paths: tuple[str, ...]
    turns: Callable[[Callable[[str, str], Column]], Column]


def _turn(role: str, text: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _listed(array: Column, role: str, text: str) -> Column:
    return F.transform(array, lambda m: F.struct(F.coalesce(m[role], F.lit("")).alias("role"), F.coalesce(m[text], F.lit("")).alias("text")))


def _pair(a: str, b: str) -> Callable:
    return lambda get: F.array(_turn("user", get(a, "string")), _turn("assistant", get(b, "string")))


def _instruction(get: Callable[[str, str], Column]) -> Column:
    given = get("input", "string")
    asked = F.concat(F.coalesce(get("instruction", "string"), F.lit("")),
                     F.when(F.coalesce(F.length(given), F.lit(0)) > 0, F.concat(F.lit("\n\n"), given)).otherwise(""))
    return F.array(_turn("user", asked), _turn("assistant", get("output", "string")))


def _from_value(get: Callable[[str, str], Column]) -> Column:
    turns = _listed(get("conversations", "array<struct<`from`:string,value:string>>"), "from", "value")
    named = lambda r: F.when(r == "human", "user").when(r == "gpt", "assistant").otherwise(r)
    return F.transform(turns, lambda t: F.struct(named(t["role"]).alias("role"), t["text"].alias("text")))


#: Declared layouts; each record's fingerprint selects at most one.
LAYOUTS = (
    Layout("prompt_response", ("prompt", "response"), _pair("prompt", "response")),
    Layout("prompt_completion", ("prompt", "completion"), _pair("prompt", "completion")),
    Layout("instruction", ("instruction", "output"), _instruction),
    Layout("instruction_input", ("instruction", "input", "output"), _instruction),
    Layout("messages", ("messages[].role", "messages[].content"),
           lambda get: _listed(get("messages", "array<struct<role:string,content:string>>"), "role", "content")),
    Layout("from_value", ("conversations[].from", "conversations[].value"), _from_value),
    Layout("turn_rows", ("turn", "role", "text"), lambda get: F.array(F.struct(
        F.coalesce(get("role", "string"), F.lit("")).alias("role"), F.coalesce(get("text", "string"), F.lit("")).alias("text")))),
)
KNOWN_PATHS = tuple(sorted({p for layout in LAYOUTS for p in layout.paths}))


def fingerprint(paths: list[str] | tuple[str, ...]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


BY_FINGERPRINT = {fingerprint(layout.paths): layout for layout in LAYOUTS}


def field_paths(schema: T.StructType) -> list[str]:
    """Nested field paths of a schema, leaves only, names without case."""

    def walk(kind: T.DataType, path: str) -> list[str]:
        if isinstance(kind, T.ArrayType):
            return walk(kind.elementType, path + "[]")
        if isinstance(kind, T.StructType):
            return [p for f in kind.fields for p in walk(f.dataType, f"{path}.{f.name}" if path else f.name)]
        return [path.lower()]

    return walk(schema, "")


def frame_layout(df: DataFrame) -> Layout:
    """The layout that a typed frame's schema selects."""
    have = [p for p in field_paths(df.schema) if p in KNOWN_PATHS]
    found = BY_FINGERPRINT.get(fingerprint(have))
    if found is None:
        raise ValueError(f"no layout has exactly the known fields {sorted(have)}")
    return found


def frame_turns(df: DataFrame, record_id: str) -> DataFrame:
    """Canonical turns (conv_id, turn, role, text) of a typed frame, by its layout."""
    layout = frame_layout(df)
    names = {c.lower(): c for c in df.columns}
    cid = F.col(f"`{record_id}`").alias("conv_id")
    turns = layout.turns(lambda path, kind: F.col(f"`{names[path]}`").cast(kind))
    if "turn" in layout.paths:  # one row a turn already
        one = turns[0]
        return df.select(cid, F.col(f"`{names['turn']}`").cast("long").alias("turn"), one["role"].alias("role"), one["text"].alias("text"))
    return df.select(cid, F.posexplode(turns).alias("turn", "t")).select("conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")


def json_turns(df: DataFrame, record_id: str, record: str) -> DataFrame:
    """Canonical turns (conv_id, layout, turn, role, text) of JSON records, each by its own layout.
    A record with an unknown layout, or that is no JSON, is one row with null layout and turn."""
    v = F.try_parse_json(F.col(f"`{record}`"))
    has = lambda p: F.try_variant_get(v, "$." + p.replace("[]", "[0]"), "variant").isNotNull()
    present = F.array_compact(F.array(*[F.when(has(p), F.lit(p)) for p in KNOWN_PATHS]))
    marked = df.select(F.col(f"`{record_id}`").alias("conv_id"), v.alias("v"), F.sha2(F.array_join(present, "\n"), 256).alias("fp"))
    get = lambda path, kind: F.try_variant_get("v", f"$.{path}", kind)
    name = turns = None
    for fp, layout in BY_FINGERPRINT.items():
        if "turn" in layout.paths:
            continue
        here = F.col("fp") == fp
        one = layout.turns(get).cast(TURN)
        name = F.when(here, layout.name) if name is None else name.when(here, layout.name)
        turns = F.when(here, one) if turns is None else turns.when(here, one)
    out = marked.select("conv_id", name.alias("layout"), F.posexplode_outer(turns).alias("turn", "t"))
    return out.select("conv_id", "layout", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def format_chats(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) -> conv_id, formatted, spans: for each turn, in order, the code point
    offsets ``start`` (of the turn), ``text_start`` and ``text_end`` in ``formatted``, and ``loss`` (assistant).
    The loss mask is the spans [text_start, text_end) with ``loss``."""
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    head = F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit(NEWLINE)), F.lit("\n"))
    t = t.select("conv_id", "turn", "role", "text", head.alias("head"), escape(F.col("text")).alias("body"))
    t = t.withColumn("n", (F.length("head") + F.length("body") + len(END)).cast("long"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = t.withColumn("no", F.row_number().over(order)).withColumn(
        "start", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    piece = F.struct("no", F.concat("head", "body", F.lit(END)).alias("piece"),
                     F.struct("start", (F.col("start") + F.length("head")).alias("text_start"),
                              (F.col("start") + F.length("head") + F.length("body")).alias("text_end"),
                              (F.col("role") == "assistant").alias("loss")).alias("span"))
    g = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    return g.select("conv_id", F.array_join(F.col("p.piece"), "").alias("formatted"), F.col("p.span").alias("spans"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """Read back what `format_chats` wrote: conv_id, formatted, turns (role, text; unescaped), loss_texts (the text under the
    loss mask, span by span, unescaped). Each span is cut from its own turn's piece, so the work is linear."""
    pieces = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda p: p != "")
    body = lambda p: F.substr(p, F.lit(len(START) + 1))
    role = lambda p: unescape(F.replace(F.substring_index(body(p), "\n", 1), F.lit(NEWLINE), F.lit("\n")))
    text = lambda p: unescape(F.substr(body(p), F.locate("\n", body(p)) + F.lit(1)))
    parsed = F.transform("pieces", lambda p: F.struct(role(p).alias("role"), text(p).alias("text")))
    masked = F.filter(F.arrays_zip("pieces", "spans"), lambda x: x["spans"]["loss"])
    cut = lambda x: F.substr(x["pieces"], (x["spans"]["text_start"] - x["spans"]["start"] + 1).cast("int"),
                             (x["spans"]["text_end"] - x["spans"]["text_start"]).cast("int"))
    return formatted.withColumn("pieces", pieces).select(
        "conv_id", "formatted", parsed.alias("turns"), F.transform(masked, lambda x: unescape(cut(x))).alias("loss_texts"))
