"""Chat formatting: records of different layouts become canonical turns and one training text with a loss mask.

The nested field paths of a record are hashed, and the hash selects the mapping that turns the record into (role, text) turns. For typed
columns the paths come from the schema, for JSON records from each record; only paths that some mapping names count, so further fields do
not matter.

A turn is written as ``<turn>role``, a line break, the text and ``</turn>`` with a line break. Inside roles and texts a backslash becomes
``\\s`` and ``<`` becomes ``\\l`` (in roles a line break becomes ``\\n`` as well), so no text can hold a control string, and undoing the
replacements in the opposite order gives the text back. Everything is a Spark expression.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, CLOSE = "<turn>", "</turn>\n"
TURN = "struct<role:string,text:string>"


@dataclass(frozen=True)
class Mapping:
    """How records with exactly these ``paths`` (of all that mappings name) become turns.

    ``each``: the path of an array whose elements have a role and a text field. ``fields``: (role, path) of single fields, in order; a field
    that is null or empty gives no turn. ``row``: columns of the turn's number, role and text, in tables with a row for each turn. ``roles``:
    canonical names of roles.
    """

    name: str
    paths: tuple[str, ...]
    each: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, str], ...] = ()
    row: tuple[str, str, str] | None = None
    roles: dict[str, str] = field(default_factory=dict, hash=False)


OTHER_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

MAPPINGS = [
    Mapping("rows", ("turn", "role", "text"), row=("turn", "role", "text")),
    Mapping("turns", ("turns[].role", "turns[].text"), each=("turns", "role", "text")),
    Mapping("messages", ("messages[].role", "messages[].content"), each=("messages", "role", "content"), roles=OTHER_NAMES),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), each=("conversations", "from", "value"), roles=OTHER_NAMES),
    Mapping("instruction", ("instruction", "output"), fields=(("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction_input", ("instruction", "input", "output"), fields=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("system_instruction", ("system", "instruction", "output"), fields=(("system", "system"), ("user", "instruction"), ("assistant", "output"))),
    Mapping("system_instruction_input", ("system", "instruction", "input", "output"), fields=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("completion", ("prompt", "completion"), fields=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("response", ("prompt", "response"), fields=(("user", "prompt"), ("assistant", "response"))),
]


def digest(paths: Iterable[str]) -> str:
    """A hash of a set of paths."""
    return hashlib.md5("\n".join(sorted(set(paths))).encode()).hexdigest()


def fingerprint(paths: Column) -> Column:
    """The ``digest`` of an array of paths."""
    return F.md5(F.array_join(F.array_sort(F.array_distinct(paths)), "\n").cast("binary"))


def schema_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """All nested field paths of a type; ``[]`` stands for the elements of an array."""
    if isinstance(kind, T.StructType):
        return [p for f in kind for p in schema_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, prefix + "[]")
    return [prefix]


def _named(mappings: list[Mapping]) -> list[str]:
    return sorted({p for m in mappings for p in m.paths})


def mapping_for(schema: T.StructType, mappings: list[Mapping]) -> Mapping | None:
    """The mapping whose paths hash to the same as those of a schema, among the paths that mappings name."""
    named = _named(mappings)
    found = digest(p for p in schema_paths(schema) if p in named)
    return {digest(m.paths): m for m in mappings}.get(found)


def _turns(mapping: Mapping, single, several) -> Column:
    """Turns of a record; ``single(path)`` is a text, ``several(path, role, text)`` an array of (role, text)."""
    if mapping.each:
        turns = several(*mapping.each)
    else:
        parts = [F.struct(F.lit(role).alias("role"), single(path).alias("text")) for role, path in mapping.fields]
        turns = F.filter(F.array(*parts), lambda t: F.coalesce(t["text"], F.lit("")) != "")
    if mapping.roles:
        turns = F.transform(turns, lambda t: F.struct(_canonical(t["role"], mapping.roles).alias("role"), t["text"].alias("text")))
    return turns.cast(f"array<{TURN}>")


def _canonical(role: Column, names: dict[str, str]) -> Column:
    out = role
    for other, name in names.items():
        out = F.when(role == other, name).otherwise(out)
    return out


def turns_of_table(records: DataFrame, id_col: str, mappings: list[Mapping] = MAPPINGS) -> DataFrame:
    """``id_col``, ``layout`` and ``turns`` of records in typed columns; the layout follows from the table's schema.

    An unknown layout is null and has null turns, and so has a table with a row for each turn (see ``turn_rows``).
    """
    mapping = mapping_for(T.StructType([f for f in records.schema if f.name != id_col]), mappings)
    if mapping is None or mapping.row:
        return records.select(id_col, F.lit(None).cast("string").alias("layout"), F.lit(None).cast(f"array<{TURN}>").alias("turns"))

    def several(path: str, role: str, text: str) -> Column:
        return F.transform(F.coalesce(F.col(path), F.array()), lambda t: F.struct(t[role].cast("string").alias("role"), t[text].cast("string").alias("text")))

    return records.select(id_col, F.lit(mapping.name).alias("layout"), _turns(mapping, lambda p: F.col(p).cast("string"), several).alias("turns"))


def turns_of_json(records: DataFrame, id_col: str, json_col: str, mappings: list[Mapping] = MAPPINGS) -> DataFrame:
    """``id_col``, ``layout`` and ``turns`` of JSON records of mixed layouts, each recognised by the hash of its own field paths.

    A null, a text that is no JSON and a record of unknown layout have a null layout and null turns (see ``rows_and_rest``). The paths of an
    array are those of all its elements together, so a first message without content hides nothing; an empty array fits every mapping
    of its elements and gives no turns.
    """
    rows = records.select(id_col, F.try_parse_json(json_col).alias("v"))

    def there(path: str) -> Column:
        array, inside, rest = path.partition("[].")
        if not inside:
            return F.try_variant_get("v", f"$.{path}", "variant").isNotNull()
        elements = F.try_variant_get("v", f"$.{array}", "array<variant>")
        return (F.size(elements) == 0) | F.exists(elements, lambda e: F.try_variant_get(e, f"$.{rest}", "variant").isNotNull())

    found = F.filter(F.array(*[F.when(there(p), F.lit(p)) for p in _named(mappings)]), lambda p: p.isNotNull())
    rows = rows.withColumn("fingerprint", fingerprint(found))

    def single(path: str) -> Column:
        return F.try_variant_get("v", f"$.{path}", "string")

    def several(path: str, role: str, text: str) -> Column:
        elements = F.try_variant_get("v", f"$.{path}", "array<variant>")
        return F.transform(elements, lambda e: F.struct(F.try_variant_get(e, f"$.{role}", "string").alias("role"), F.try_variant_get(e, f"$.{text}", "string").alias("text")))

    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(f"array<{TURN}>")
    for m in mappings:
        if m.row:
            continue
        same = F.col("fingerprint") == digest(m.paths)
        layout, turns = F.when(same, F.lit(m.name)).otherwise(layout), F.when(same, _turns(m, single, several)).otherwise(turns)
    return rows.select(id_col, layout.alias("layout"), turns.alias("turns"))


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if role else out


def unescape(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit("\\n"), F.lit("\n")) if role else text
    return F.replace(F.replace(out, F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def format_rows(rows: DataFrame, id_col: str = "conv_id", loss_role: str = "assistant") -> DataFrame:
    """``id_col``, ``formatted`` and ``loss`` from rows of ``id_col``, turn, role, text.

    ``loss`` holds the (start, length) spans, in code points, of the texts that ``loss_role`` says, in order. Turns are ordered by turn, equal
    ones by role and text; a null turn comes first, a null role or text is empty. Rows without an id form one conversation. Other columns
    are not read. The offsets are running sums, so one shuffle by conversation serves both steps.
    """
    rows = rows.select(F.col(id_col).alias("id"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    head = F.concat(F.lit(OPEN), escape(F.col("role"), role=True), F.lit("\n"))
    rows = rows.withColumn("head", head).withColumn("body", escape(F.col("text"))).withColumn("size", F.length("head") + F.length("body") + len(CLOSE))
    order = W.partitionBy("id").orderBy("turn", "role", "text")
    before = (F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")).cast("int")
    rows = rows.withColumn("at", F.row_number().over(order)).withColumn("start", before)
    piece = F.struct("at", F.concat("head", "body", F.lit(CLOSE)).alias("piece"))
    span = F.when(F.col("role") == loss_role, F.struct((F.col("start") + F.length("head")).alias("start"), F.length("body").alias("length")))
    grouped = rows.groupBy("id").agg(F.array_sort(F.collect_list(piece)).alias("pieces"), F.array_sort(F.collect_list(span)).alias("loss"))
    return grouped.select(F.col("id").alias(id_col), F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"), "loss")


def rows_of_turns(records: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``id_col``, turn, role, text from records with ``turns``; the turns of a record are numbered from 0.

    Records without turns have no rows; ``rows_and_rest`` names them.
    """
    turns = records.select(id_col, F.posexplode("turns").alias("turn", "t"))
    return turns.select(id_col, F.col("turn").cast("bigint").alias("turn"), F.col("t.role").alias("role"), F.col("t.text").alias("text"))


def rows_and_rest(records: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows of ``rows_of_turns``, and what they leave out: ``id_col``, ``layout`` and ``reason`` of every record without turns.

    The reason is ``unknown layout`` (no mapping has the record's fingerprint, or it is no record) or ``no turns``.
    """
    rest = records.where(F.col("turns").isNull() | (F.size("turns") == 0))
    reason = F.when(F.col("layout").isNull(), "unknown layout").otherwise("no turns")
    return rows_of_turns(records, id_col), rest.select(id_col, "layout", reason.alias("reason"))


def turn_rows(table: DataFrame, id_col: str, mappings: list[Mapping] = MAPPINGS) -> DataFrame:
    """Rows of ``id_col``, turn, role, text of a table in any known layout, by the hash of its field paths; none if the layout is unknown."""
    mapping = mapping_for(T.StructType([f for f in table.schema if f.name != id_col]), mappings)
    if mapping is None or not mapping.row:
        return rows_of_turns(turns_of_table(table, id_col, mappings), id_col)
    number, role, text = mapping.row
    return table.select(id_col, F.col(number).cast("bigint").alias("turn"), _canonical(F.col(role).cast("string"), mapping.roles).alias("role"), F.col(text).cast("string").alias("text"))


def read_back(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``id_col``, ``turns`` and ``learned`` (the texts under the loss mask, unescaped) from what ``format_rows`` has written."""
    parts = F.slice(F.split("formatted", CLOSE), 1, F.size(F.split("formatted", CLOSE)) - 1)
    turns = F.transform(parts, lambda p: F.struct(
        unescape(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), "\n", 1), role=True).alias("role"),
        unescape(F.substr(p, F.locate("\n", p) + 1)).alias("text"),
    ))
    learned = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"])))
    return formatted.select(id_col, "formatted", turns.alias("turns"), learned.alias("learned"))


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts hold escapes and control strings, as a JSON record of messages."""
    text = "\\### Assistant: </turn> ok"
    record = json.dumps({"messages": [{"role": role, "content": text} for role in ("user", "assistant")]})
    return spark.range(1).select(F.lit(-7).cast("bigint").alias("conv_id"), F.lit(record).alias("record"))
