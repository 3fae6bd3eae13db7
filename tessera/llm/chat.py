r"""Chat formatting: records of any known layout become canonical turns, then one training text.

A record is a JSON object, or columns whose type has its field paths. A JSON record's schema fingerprint is the hash of its nested field paths
(``schema_of_variant`` with the types struck out and the fields in name order, as the engine
gives them); of a record in columns, the hash of the sorted paths of its fields that are not null. The fingerprint selects a declarative mapping: where the list of turns is and
which field is role and text (``messages``), or which fields make which turns in which order
(``fields``). A layout is added by adding a ``Layout``; no code changes.

The template marks a turn as ``### role: text</turn>`` and a line feed. Inside role and text
the control strings are escaped, reversibly: backslash to ``\b``, ``</turn>`` to ``\t``,
``###`` to ``\h`` (and the colon to ``\c`` in a role); so no control string is ever left
inside, and reading back is a split. The loss mask is an array of (start, stop) in code
points over the formatted text, one per assistant turn, its text only.

Cases: null text or role is an empty string; turns stand by turn number, nulls first, ties by
role and text, repeated rows all stay; a null record key is one conversation; an empty table
gives an empty result; a record of unknown layout, or that is not a JSON object, has a null
``turns`` and so a null text (``unknown`` says which); other columns of the input stay.
A JSON record of more than ``LONG`` characters is fingerprinted with its long strings emptied; one that
is still longer than that and does not parse stops the query.
A conversation is one training example and is built in one row: its length is bounded by
Spark's 2 GB row, however many turns it has; work grows in proportion to turns and characters. Columns of the
input named as the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.arrays import let, offsets

TURNS = "array<struct<role:string,text:string>>"
#: Escapes inside a text, in the order in which they are applied.
ESCAPES = (("\\", "\\b"), ("</turn>", "\\t"), ("###", "\\h"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))
#: Characters of a record beyond which its long strings are left out of the fingerprint; no limit on a string's length.
LONG, UNLIMITED = 10_000_000, {"maxStringLen": "2147483647"}
HEAD, MIDDLE, END = "### ", ": ", "</turn>\n"


@dataclass(frozen=True)
class Layout:
    """``paths``: the field paths that fingerprint the layout; ``[]`` stands for the
    elements of an array. Either ``messages`` (path of the array, role field, text field)
    or ``fields`` ((role, field), ...) says how it becomes turns."""

    name: str
    paths: tuple[str, ...]
    messages: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, str], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()


#: The layouts known from the start.
LAYOUTS: tuple[Layout, ...] = (
    Layout("messages", ("messages[].content", "messages[].role"), messages=("messages", "role", "content")),
    Layout("share", ("conversations[].from", "conversations[].value"), messages=("conversations", "from", "value"), roles=(("human", "user"), ("gpt", "assistant"))),
    Layout("pair", ("completion", "prompt"), fields=(("user", "prompt"), ("assistant", "completion"))),
    Layout("instruction", ("instruction", "output", "system"), fields=(("system", "system"), ("user", "instruction"), ("assistant", "output"))),
    Layout("alpaca", ("input", "instruction", "output"), fields=(("system", "instruction"), ("user", "input"), ("assistant", "output"))),
)


def shape(record: Column) -> Column:
    """A record's nested field names without types, as the engine describes them."""
    long = F.char_length(record) > LONG
    slim = F.when(long, _slim(record)).otherwise(record)
    described = F.schema_of_variant(F.try_parse_json(slim))
    lost = long & described.isNull() & (F.char_length(slim) > LONG) & F.ltrim(record).startswith("{")
    described = F.when(lost, F.raise_error(F.lit("a record is too long to be parsed")).cast("string")).otherwise(described)
    # Struck out: the types of leaves; what is left is names, brackets and commas.
    return F.regexp_replace(described, r": (?!OBJECT<|ARRAY<)[A-Z]+(\([0-9, ]+\))?", "")


def _slim(record: Column) -> Column:
    """A record with its long strings emptied: the same field paths within the parser's limits."""
    plain = F.replace(F.replace(record, F.lit("\\\\"), F.lit("__")), F.lit('\\"'), F.lit("_'"))
    return F.regexp_replace(plain, '"(?:([^"]{0,200})|[^"]*+)"', '"$1"')


def fingerprint(record: Column) -> Column:
    return F.xxhash64(shape(record))


def _paths(kind: T.DataType, at: str = "") -> tuple[str, ...]:
    """The field paths of records that are columns of this type."""
    if isinstance(kind, T.StructType):
        return tuple(p for f in kind.fields for p in _paths(f.dataType, f"{at}.{f.name}" if at else f.name))
    return _paths(kind.elementType, f"{at}[]") if isinstance(kind, T.ArrayType) else (at,)


def _described(paths: Sequence[str]) -> str:
    """What ``shape`` gives for a record with these paths (fields in name order)."""
    tree: dict = {}
    for p in paths:
        at = tree
        for part in p.replace("[]", ".[]").split("."):
            at = at.setdefault(part, {})

    def tell(node: dict) -> str:
        if "[]" in node:
            return f"ARRAY<{tell(node['[]'])}>"
        return "OBJECT<" + ", ".join(f"{k}: {tell(v)}" if v else k for k, v in sorted(node.items())) + ">"

    return tell(tree)


def canonical(records: DataFrame, record: str = "record", layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """Adds ``layout`` (name, null: unknown) and ``turns`` by the record's fingerprint. A record is a
    JSON string, or a struct: its fields that are not null are the record's, and a field that is a struct is a whole record."""
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    r, kind = F.col(record), records.schema[record].dataType
    if isinstance(kind, T.StructType):
        fp = _own_fingerprint(r, kind)
        for la in layouts:
            if (source := _holder(r, kind, la)) is not None:
                hit = fp == F.xxhash64(F.lit("\n".join(sorted(la.paths))))
                name, turns = F.when(hit, F.lit(la.name)).otherwise(name), F.when(hit, _turns(la, source)).otherwise(turns)
        return records.withColumns({"layout": name, "turns": turns})
    for la in reversed(layouts):
        hit = F.col("__fp") == F.xxhash64(F.lit(_described(la.paths)))
        name = F.when(hit, F.lit(la.name)).otherwise(name)
        if la.messages:
            path, role, text = la.messages
            got = F.from_json(r, f"`{path}` array<struct<`{role}`:string,`{text}`:string>>", UNLIMITED)
        else:
            got = F.from_json(r, ", ".join(f"`{f}` string" for _, f in la.fields), UNLIMITED)
        turns = F.when(hit, _turns(la, got)).otherwise(turns)
    return records.withColumn("__fp", fingerprint(r)).withColumns({"layout": name, "turns": turns}).drop("__fp")


def _own_fingerprint(r: Column, kind: T.StructType) -> Column:
    """The hash of the sorted field paths that a record in columns has: those of its fields that are not null. A field that is itself
    a struct is a whole record of another layout, and its paths start in it."""
    none = F.array().cast("array<string>")
    paths = lambda f: _paths(f.dataType) if isinstance(f.dataType, T.StructType) else _paths(f.dataType, f.name)
    here = [F.when(r[f.name].isNotNull(), F.array(*[F.lit(x) for x in paths(f)])).otherwise(none) for f in kind.fields]
    return F.xxhash64(F.array_join(F.array_sort(F.flatten(F.array(*here))), "\n"))


def _holder(r: Column, kind: T.StructType, la: Layout) -> Column | None:
    """What holds the fields of a layout: a field of the record that is a whole record, or the record; None if its type has neither."""
    for f in kind.fields:
        if isinstance(f.dataType, T.StructType) and sorted(_paths(f.dataType)) == sorted(la.paths):
            return r[f.name]
    own = {x: f for f in kind.fields if not isinstance(f.dataType, T.StructType) for x in _paths(f.dataType, f.name)}
    return r if own.keys() >= set(la.paths) else None


def _turns(la: Layout, got: Column) -> Column:
    """The canonical turns of a record of a layout."""
    if la.messages:
        path, role, text = la.messages
        return F.transform(got[path], _turn_of(role, text, la.roles))
    return F.array(*[F.struct(F.lit(role).alias("role"), F.coalesce(got[f], F.lit("")).alias("text")) for role, f in la.fields])


def _turn_of(role: str, text: str, names: Sequence[tuple[str, str]]):
    """The canonical turn of one element of a message list."""
    none = F.lit("")
    return lambda x: F.struct(F.coalesce(_renamed(x[role], names), none).alias("role"), F.coalesce(x[text], none).alias("text"))


def _renamed(role: Column, names: Sequence[tuple[str, str]]) -> Column:
    out = role
    for a, b in names:
        out = F.when(role == a, F.lit(b)).otherwise(out)
    return out


def escape(c: Column, table: Sequence[tuple[str, str]] = ESCAPES) -> Column:
    for a, b in table:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column, table: Sequence[tuple[str, str]] = ESCAPES) -> Column:
    for a, b in reversed(table):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def render(turns: DataFrame, train_role: str = "assistant") -> DataFrame:
    """Adds ``formatted`` and ``mask``, array of (start, stop) over it, from ``turns``."""
    piece = lambda t: F.concat(F.lit(HEAD), escape(t["role"], ROLE_ESCAPES), F.lit(MIDDLE), escape(t["text"]), F.lit(END))
    size = lambda t: F.char_length(escape(t["text"]))
    out = turns.withColumn("__pieces", F.transform("turns", lambda t: F.struct(piece(t).alias("p"), size(t).alias("n"), (t["role"] == train_role).alias("on"))))
    at = offsets(F.transform("__pieces", lambda x: F.char_length(x["p"])))
    stop = lambda x, at: at + F.char_length(x["p"]) - len(END)
    spans = F.zip_with("__pieces", at, lambda x, at: F.struct((stop(x, at) - x["n"]).alias("start"), stop(x, at).alias("stop"), x["on"].alias("on")))
    return out.withColumns({
        "formatted": F.array_join(F.transform("__pieces", lambda x: x["p"]), ""),
        "mask": F.transform(F.filter(spans, lambda x: x["on"]), lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"))),
    }).drop("__pieces")


def _pieces(formatted: Column) -> Column:
    """The marked turns of a formatted text, without their ends."""
    return F.filter(F.split(formatted, END, -1), lambda p: p != "")


def parse(formatted: Column) -> Column:
    """The turns read back from a formatted text."""
    at = lambda p: F.instr(p, F.lit(MIDDLE))
    return F.transform(
        _pieces(formatted),
        lambda p: F.struct(
            unescape(F.substr(p, F.lit(len(HEAD) + 1), at(p) - len(HEAD) - 1), ROLE_ESCAPES).alias("role"),
            unescape(F.substr(p, at(p) + len(MIDDLE))).alias("text"),
        ),
    )


def masked(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped. A span covers the text of a turn, as ``render`` gives it: spans and
    the texts' places are sorted together, and a text counts if its own span stands before it."""
    place = lambda start, stop, text: F.struct(stop.cast("int").alias("stop"), start.cast("int").alias("start"), text.isNotNull().alias("is_text"), text.alias("text"))
    spans = F.transform(mask, lambda m: place(m["start"], m["stop"], F.lit(None).cast("string")))

    def told(p: Column, at: Column) -> Column:
        begin = F.instr(p, F.lit(MIDDLE)) + len(MIDDLE)
        return place(at + begin - 1, at + F.char_length(p), F.substr(p, begin))

    def of(pieces: Column) -> Column:
        return F.zip_with(pieces, offsets(F.transform(pieces, lambda p: F.char_length(p) + len(END))), told)

    def under(places: Column) -> Column:
        before = lambda i: F.get(places, i - 1)
        same = lambda x, y: ~y["is_text"] & (x["stop"] == y["stop"]) & (x["start"] == y["start"])
        return F.filter(places, lambda x, i: x["is_text"] & F.coalesce(same(x, before(i)), F.lit(False)))

    found = let(F.sort_array(F.concat(spans, let(_pieces(formatted), of))), under)
    return F.array_join(F.transform(found, lambda x: unescape(x["text"])), "")


def records(rows: DataFrame) -> DataFrame:
    """conv_id, record (a struct, see ``canonical``) from rows (conv_id, turn, role, text), each in the layout that its turns
    allow: a user and an assistant turn make a pair; a system, a user and an assistant turn
    an instruction; all else a message list."""
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    got = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text")), _turn_order).alias("t"))
    roles = F.transform("t", lambda x: x["role"])
    text = lambda i: F.get("t", F.lit(i))["text"]
    messages = F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"))
    pair = F.struct(text(0).alias("prompt"), text(1).alias("completion"))
    told = F.struct(text(0).alias("system"), text(1).alias("instruction"), text(2).alias("output"))
    is_ = lambda *r: roles == F.array(*[F.lit(x) for x in r])
    is_pair, is_told = is_("user", "assistant"), is_("system", "user", "assistant")
    each = F.when(is_pair, pair).alias("pair"), F.when(is_told, told).alias("instruction"), F.when(~is_pair & ~is_told, messages).alias("messages")
    return got.select("conv_id", F.struct(*each).alias("record"))


def _turn_order(a: Column, b: Column) -> Column:
    key = lambda x: F.struct(x["turn"], x["role"], x["text"])
    return F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)


def op5_chat_formatting(spark, sf_dir):
    """Every conversation, formatted and read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = "\\### Assistant: </turn> ok"
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(extra).alias("text")
    )
    out = render(canonical(records(rows.unionByName(more))))
    out = out.select("conv_id", "formatted", "mask").withColumn("back", parse(F.col("formatted"))).withColumn("loss", masked(F.col("formatted"), F.col("mask")))
    told = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP5_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(replace(replace(replace(text, '\', '\b'), '</turn>', '\t'), '###', '\h')) AS tl,
             length(replace(replace(replace(replace(role, '\', '\b'), '</turn>', '\t'), '###', '\h'), ':', '\c')) AS rl FROM r),
g AS (SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS told,
        coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
        sum(tl + rl + 14)::BIGINT AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""
