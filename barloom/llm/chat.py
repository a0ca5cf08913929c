"""Chat formatting by schema fingerprints.

Records arrive as JSON of unknown layout: a prompt with a response, an instruction with an input and an output, or a list
of messages under various names. Its texts are first struck out, so that only JSON structure is left and no text can pass for
structure; the nested field paths of the rest are hashed, and the hash selects a declarative mapping (a table of JSON paths and roles) that turns the record into canonical turns. A new layout is a new entry of the
table. The turns are then written with one template, in which every assistant text is under the loss mask.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN = "array<struct<role:string,text:string>>"
#: Strings of the template; a backslash is put inside them where a text contains them.
OPEN, MIDDLE, CLOSE = "<s>[INST]", "[/INST]", "</s>"
#: Jackson's default of 20,000,000 characters would turn longer texts into NULL.
WHOLE = {"maxStringLen": "2147483647"}
#: A JSON string; and whatever stands before the next one that is a text (field names are followed by a colon), then that text.
_STRING = r'"[^"\\]*+(?:\\(?s:.)[^"\\]*+)*+"'
_NEXT_TEXT = rf'\G(?<before>[^"]*+(?:{_STRING}\s*+:[^"]*+)*+){_STRING}'
_RAW, _ESCAPED = r"([<\[])(\\*/?(?:s>|INST\]))", r"([<\[])\\(\\*/?(?:s>|INST\]))"


@dataclass(frozen=True)
class Layout:
    """Where a layout keeps its turns.

    ``fields`` lists (path, role) of single texts in turn order; ``listed`` is (path of the list, role field, text field).
    ``paths`` are all field paths of the layout, such as ``messages[].content``.
    """

    name: str
    paths: tuple[str, ...]
    fields: tuple[tuple[str, str], ...] = ()
    listed: tuple[str, str, str] | None = None
    rename_roles: bool = False


LAYOUTS = (
    Layout("prompt", ("prompt", "response"), (("prompt", "user"), ("response", "assistant"))),
    Layout("completion", ("completion", "prompt"), (("prompt", "user"), ("completion", "assistant"))),
    Layout("instruction", ("instruction", "output"), (("instruction", "user"), ("output", "assistant"))),
    Layout(
        "instruction_input", ("input", "instruction", "output"),
        (("instruction", "system"), ("input", "user"), ("output", "assistant")),
    ),
    Layout("messages", ("messages[].content", "messages[].role"), listed=("messages", "role", "content")),
    Layout("conversations", ("conversations[].from", "conversations[].value"), listed=("conversations", "from", "value"), rename_roles=True),
)
#: Other names of roles in the wild.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant"}


def skeleton(record: Column) -> Column:
    """The JSON record with a 0 for every text that isn't a field name."""
    return F.regexp_replace(record, _NEXT_TEXT, "${before}0")


def field_shape(record: Column) -> Column:
    """The nested fields of a JSON record, objects and lists to any depth, with ``_`` for what is neither; NULL if malformed.

    Fields are in order of their names; the items of a list are merged.
    """
    shape = F.schema_of_variant(F.try_parse_json(skeleton(record)))
    return F.regexp_replace(shape, r"(?<=: |ARRAY<)[A-Z]+(?:\([0-9,]+\))?(?=[,>])", "_")


def shape_of(paths: tuple[str, ...]) -> str:
    """The shape of a record that has exactly these paths."""
    tree: dict = {}
    for path in paths:
        at = tree
        for part in path.split("."):
            at = at.setdefault(part, {})

    def shown(fields: dict) -> str:
        if not fields:
            return "_"
        parts = []
        for name, inner in sorted((n.removesuffix("[]"), (n.endswith("[]"), f)) for n, f in fields.items()):
            parts.append(f"{name}: " + (f"ARRAY<{shown(inner[1])}>" if inner[0] else shown(inner[1])))
        return f"OBJECT<{', '.join(parts)}>"

    return shown(tree)


def _fields(record: Column) -> Column:
    return F.from_json(record, "map<string,string>", WHOLE)


def fingerprint(shape: Column) -> Column:
    return F.xxhash64(shape)


def _canonical(role: Column, rename: bool) -> Column:
    known = F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair])
    return F.coalesce(*[F.element_at(known, role)] * rename, role, F.lit(""))


def turns_of(record: Column, mark: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Canonical turns of a record whose layout has the fingerprint ``mark``; NULL if no layout has it."""
    chosen = None
    for lay in layouts:
        fits = mark == fingerprint(F.lit(shape_of(lay.paths)))
        if lay.listed:
            path, role, text = lay.listed
            items = F.from_json(record, f"{path} array<struct<`{role}`:string,`{text}`:string>>", WHOLE)[path]
            turns = F.transform(
                items, lambda m: F.struct(_canonical(m[role], lay.rename_roles).alias("role"), F.coalesce(m[text], F.lit("")).alias("text"))  # noqa: B023
            )
        else:
            parsed = F.from_json(record, ",".join(f"`{p}` string" for p, _ in lay.fields), WHOLE)
            turns = F.array(
                *[F.struct(F.lit(r).alias("role"), F.coalesce(parsed[p], F.lit("")).alias("text")) for p, r in lay.fields]
            )
            given = _fields(record)
            lost = [parsed[p].isNull() & F.element_at(given, p).isNotNull() for p, _ in lay.fields]
            turns = F.when(~F.coalesce(reduce(or_, lost, given.isNull()), F.lit(True)), turns)  # a text that doesn't parse isn't an empty one
        chosen = F.when(fits, turns.cast(TURN)) if chosen is None else chosen.when(fits, turns.cast(TURN))
    return chosen


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _RAW, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2")


def format_chats(df: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Add layout_mark (the fingerprint), formatted, and loss_mask to records in JSON.

    formatted is ``<s>[INST]role[/INST]text</s>`` for each turn. loss_mask lists (start, length), in code points, of the
    assistant texts. A record of an unknown layout, malformed or null, or with a text that can't be parsed, gets NULL in both; its fingerprint says which layout
    to add. A null text is empty, a null role is the empty role; a record without turns gives an empty string.
    """
    df = df.withColumn("layout_mark", fingerprint(field_shape(F.col(record)))).withColumn("_turns", turns_of(F.col(record), F.col("layout_mark"), layouts))
    pieces = F.transform(
        "_turns",
        lambda t: F.struct(
            F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MIDDLE)).alias("head"), escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("learn")
        ),
    )
    df = df.withColumn("_pieces", pieces)
    df = df.withColumn("_len", F.transform("_pieces", lambda p: F.length(p["head"]) + F.length(p["body"]) + len(CLOSE)))
    before = F.transform("_len", lambda _, i: F.aggregate(F.slice(F.col("_len"), 1, i), F.lit(0), lambda a, n: a + n))
    df = df.withColumn("_before", before)
    spans = F.transform(
        "_pieces",
        lambda p, i: F.struct((F.get("_before", i) + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length"), p["learn"].alias("learn")),
    )
    mask = F.transform(F.filter(spans, lambda s: s["learn"]), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))
    text = F.array_join(F.transform("_pieces", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")
    return df.withColumn("formatted", text).withColumn("loss_mask", mask).drop("_turns", "_pieces", "_len", "_before")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted record, texts as they were."""
    pieces = F.filter(F.split(formatted, CLOSE), lambda p: p != "")
    head = F.length(F.lit(OPEN))

    def turn(p: Column) -> Column:
        role = F.substring_index(p, MIDDLE, 1)
        return F.struct(
            unescape(F.substring(role, head + 1, F.length(role))).alias("role"),
            unescape(F.substring(p, F.length(role) + len(MIDDLE) + 1, F.length(p))).alias("text"),
        )

    return F.transform(pieces, turn)


def read_loss(formatted: Column, mask: Column) -> Column:
    """The text under the loss mask, as it was."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def gather_turns(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """One JSON record per conversation from rows by turn, in the layout its roles fit: prompt, instruction or messages."""
    turns = F.array_sort(F.collect_list(F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    convs = rows.groupBy(key).agg(turns.alias("_turns"))
    roles = F.array_join(F.transform("_turns", lambda t: t["role"]), ",")

    def text(i: int) -> Column:
        return F.col("_turns")[i]["text"]

    messages = F.transform("_turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    record = (
        F.when(roles == "user,assistant", F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("response"))))
        .when(
            roles == "system,user,assistant",
            F.to_json(F.struct(text(0).alias("instruction"), text(1).alias("input"), text(2).alias("output"))),
        )
        .otherwise(F.to_json(F.struct(messages.alias("messages"))))
    )
    return convs.select(key, record.alias("record"))
