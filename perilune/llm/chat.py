"""Operator 4 [native]: chat formatting with schema fingerprints.

A table's layout is known by a hash of its nested field paths, which selects a declared mapping to canonical turns (conv_id,
turn, role, text). Fields that no layout knows are left out of the hash, so further columns do no harm, nor do those of another layout. Rows of JSON
text are told apart one by one by the same hash of their paths. Then turns are escaped, formatted and joined.

Null roles and texts are empty; a null turn comes first; turns with equal numbers are ordered by role, then text; repeated rows
are repeated turns; null conv_ids are one conversation. Text of any length is held whole: a conversation is one row. Blocks
of turns are joined first, so a conversation with very many turns reaches its last task as few, already formatted rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The template's control strings. Those that begin with "<|" are its own marks; all are escaped inside texts.
BEGIN, TURN, TEXT, END, CLOSE = "<s>", "<|turn|>", "<|text|>", "<|end|>", "</s>"
_CONTROL = r"([<\[])(?=\||/?s>|/?INST\])"
_ESCAPED = r"([<\[])\\(?=\||/?s>|/?INST\])"


def escape(text: Column) -> Column:
    """A backslash is doubled; the first character of a control string gets a backslash behind it."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, _ESCAPED, "$1"), F.lit("\\\\"), F.lit("\\"))


def field_paths(schema: T.DataType, at: str = "") -> list[str]:
    if isinstance(schema, T.StructType):
        return [p for f in schema for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, f"{at}[]")
    return [at]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _turns(*pairs: tuple[Column | str, str]) -> Column:
    """An array of (turn, role, text) from (role, path) pairs; those with a null text are left out."""
    one = [F.struct(F.lit(k).cast("long").alias("turn"), (F.lit(r) if isinstance(r, str) else r).alias("role"), F.col(p).cast("string").alias("text")) for k, (r, p) in enumerate(pairs)]
    return F.filter(F.array(*one), lambda x: x["text"].isNotNull())


def _messages(path: str, role: str, text: str, names: dict[str, str] | None = None) -> Column:
    def one(x: Column, k: Column) -> Column:
        r = x[role]
        for old, new in (names or {}).items():
            r = F.when(x[role] == old, new).otherwise(r)
        return F.struct(k.cast("long").alias("turn"), r.alias("role"), x[text].alias("text"))

    return F.transform(F.col(path), one)


# Declared layouts: field paths -> an array of canonical turns.
LAYOUTS: list[tuple[list[str], Callable[[], Column]]] = [
    (["conv_id", "turn", "role", "text"], lambda: F.array(F.struct(F.col("turn").cast("long").alias("turn"), "role", "text"))),
    (["conv_id", "messages[].role", "messages[].content"], lambda: _messages("messages", "role", "content")),
    (["conv_id", "conversations[].from", "conversations[].value"], lambda: _messages("conversations", "from", "value", {"human": "user", "gpt": "assistant"})),
    (["conv_id", "prompt", "response"], lambda: _turns(("user", "prompt"), ("assistant", "response"))),
    (["conv_id", "prompt", "completion"], lambda: _turns(("user", "prompt"), ("assistant", "completion"))),
    (["conv_id", "instruction", "input", "output"], lambda: F.array(
        F.struct(F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.concat_ws("\n\n", F.col("instruction"), F.when(F.col("input") != "", F.col("input"))).alias("text")),
        F.struct(F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role"), F.col("output").alias("text")))),
    (["conv_id", "instruction", "output"], lambda: _turns(("user", "instruction"), ("assistant", "output"))),
]
_BY_PRINT = {fingerprint(paths): make for paths, make in LAYOUTS}
_KNOWN = {p for paths, _ in LAYOUTS for p in paths}


def canonical_turns(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of a table in any declared layout; an unknown layout is an error.

    The hash is of all fields that any layout knows; if a table has fields of several layouts, the first one that it holds whole counts.
    """
    paths = [p for p in field_paths(df.schema) if p in _KNOWN]
    make = _BY_PRINT.get(fingerprint(paths))
    if make is None:
        prints = (fingerprint([p for p in paths if p in own]) for own, _ in LAYOUTS)
        make = next((_BY_PRINT[x] for x, (own, _) in zip(prints, LAYOUTS, strict=True) if x == fingerprint(own)), None)
    if make is None:
        raise ValueError(f"no layout for the fields {sorted(paths)}")
    return df.select(F.col("conv_id").cast("long").alias("conv_id"), F.inline(make())).select("conv_id", "turn", "role", "text")


#: For rows of JSON text: a type that reads every declared layout.
_JSON = "conv_id long, messages array<struct<role:string,content:string>>, conversations array<struct<`from`:string,value:string>>, prompt string, response string, completion string, instruction string, input string, output string"
_TURNS = "array<struct<turn:bigint,role:string,text:string>>"


def _present(path: str) -> Column:
    """Whether a row of JSON has a path; a list has its elements' fields if one element has them, or if it is empty."""
    if "[]." not in path:
        return F.try_variant_get(F.col("v"), f"$.{path}", "variant").isNotNull()
    held, name = path.split("[].")
    return F.coalesce(F.col(f"x.{held}").isNotNull() & ((F.size(f"x.{held}") == 0) | F.exists(f"x.{held}", lambda e: e[name].isNotNull())), F.lit(False))


def _matched(df: DataFrame, column: str) -> DataFrame:
    """The rows with `x` (their known fields) and `layout`: the place of the one they fit, null without one. The hash is of the known paths that a row has; further fields do no harm."""
    known = sorted({p for paths, _ in LAYOUTS[1:] for p in paths})
    rows = df.withColumn("v", F.try_parse_json(F.col(column))).withColumn("x", F.from_json(F.col(column), _JSON))
    rows = rows.withColumn("print", F.sha2(F.concat_ws("\n", *(F.when(_present(p), p) for p in known)), 256))
    exact = [F.when(F.col("print") == fingerprint(paths), k) for k, (paths, _) in enumerate(LAYOUTS) if k]
    whole = [F.when(reduce(lambda a, b: a & b, map(_present, paths)), k) for k, (paths, _) in enumerate(LAYOUTS) if k]
    return rows.withColumn("layout", F.coalesce(*exact, *whole))


def canonical_turns_json(df: DataFrame, column: str = "json") -> DataFrame:
    """The same from JSON texts whose layouts differ by row. If a row has fields of several layouts, the first one that it holds whole counts. `misfits` has the rows that aren't JSON or fit none."""
    rows = _matched(df.select(column), column).select("x.*", "layout")
    chosen = F.lit(None).cast(_TURNS)
    for k, (_, make) in enumerate(LAYOUTS):
        chosen = F.when(F.col("layout") == k, make()).otherwise(chosen) if k else chosen
    return rows.select("conv_id", F.inline(chosen)).select("conv_id", "turn", "role", "text")


def misfits(df: DataFrame, column: str = "json") -> DataFrame:
    """The rows, as they are, that aren't JSON or fit no layout."""
    held = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row")
    return _matched(df.select(held, F.col(column).alias("_json")), "_json").where("layout is null").select("_row.*")


def format_chats(turns: DataFrame, block: int = 256) -> DataFrame:
    """conv_id, formatted: one row for each conversation."""
    one = F.concat(F.lit(TURN), escape(F.coalesce("role", F.lit(""))), F.lit(TEXT), escape(F.coalesce("text", F.lit(""))), F.lit(END))
    part = F.floor(F.col("turn") / block).alias("part")
    join = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["s"]), "")
    blocks = turns.select("conv_id", part, "turn", "role", "text", one.alias("s")).groupBy("conv_id", "part").agg(join(F.struct(F.coalesce("turn", F.lit(-(1 << 62))).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "s")).alias("s"))
    whole = blocks.groupBy("conv_id").agg(join(F.struct(F.coalesce("part", F.lit(-(1 << 62))).alias("part"), "s")).alias("s"))
    return whole.select("conv_id", F.concat(F.lit(BEGIN), "s", F.lit(CLOSE)).alias("formatted"))


def read_chats(chats: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, turns: array of (role, text, loss), unescaped, as the formatted text has them; loss: under the mask."""
    inner = F.expr(f"substring(formatted, {len(BEGIN) + 1}, length(formatted) - {len(BEGIN) + len(CLOSE)})")
    pieces = F.filter(F.split(inner, r"<\|turn\|>", -1), lambda x: x != "")

    def parse(piece: Column) -> Column:
        role = unescape(F.substring_index(piece, TEXT, 1))
        text = unescape(F.substring_index(F.substring_index(piece, TEXT, -1), END, 1))
        return F.struct(role.alias("role"), text.alias("text"), role.isin(*learn).alias("loss"))

    return chats.select("conv_id", "formatted", F.transform(pieces, parse).alias("turns"))
