r"""Chat formatting: records of many layouts become canonical turns, then one marked text each.

The layout of a record is recognised by its fingerprint: a hash of its sorted nested field paths.  The
fingerprint selects a declarative mapping that says where roles and texts are.  A table whose rows are
turns is recognised by the fingerprint of its schema, JSON records by that of each record.

A turn is ``<|im_start|>role\ntext<|im_end|>\n``.  Control strings inside texts and roles are escaped
with backslashes and come back exactly: a backslash becomes ``\e``, the opening ``<`` or ``[`` of a
control string ``\l`` or ``\b``, a line feed in a role ``\n``.

Edge cases: a null text is an empty text and a null role an empty role; turns with equal numbers go by
role, then text; a null conversation id is a conversation of its own; records of unknown layout or
invalid JSON give no turns (null); an empty table gives an empty result.  A conversation is one text by
nature, so its turns do meet in one task; nothing larger does.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from lociform.llm.common import between, running, utf32

START, END = "<|im_start|>", "<|im_end|>\n"
#: Strings that texts must not contain unescaped.
CONTROL = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ANGLE = "|".join(re.escape(c[1:]) for c in CONTROL if c[0] == "<")
_SQUARE = "|".join(re.escape(c[1:]) for c in CONTROL if c[0] == "[")
TURNS = "array<struct<role:string,text:string>>"


def escape(c: Column) -> Column:
    """No control string is left; unescape() gives the text back."""
    c = F.replace(c, F.lit("\\"), F.lit("\\e"))
    c = F.regexp_replace(c, f"<(?={_ANGLE})", r"\\l")
    return F.regexp_replace(c, rf"\[(?={_SQUARE})", r"\\b")


def unescape(c: Column) -> Column:
    for mark, char in (("\\l", "<"), ("\\b", "["), ("\\n", "\n"), ("\\e", "\\")):
        c = F.replace(c, F.lit(mark), F.lit(char))
    return c


# ---- layouts ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns.

    paths: the nested field paths that make up its fingerprint, ``[]`` for an element of an array.
    turns: for flat layouts (role, path of the text); optional texts that are empty give no turn.
    items: for lists of messages (path of the list, field of the role, field of the text).
    roles: other names for roles.
    """

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...] = ()
    items: tuple[str, str, str] | None = None
    roles: tuple[tuple[str, str], ...] = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))


MAPPINGS = (
    Mapping("turn rows", ("conv_id", "role", "text", "turn"), items=("", "role", "text")),
    Mapping("prompt and completion", ("completion", "prompt"), (("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt and response", ("prompt", "response"), (("user", "prompt"), ("assistant", "response"))),
    Mapping("question and answer", ("answer", "question"), (("user", "question"), ("assistant", "answer"))),
    Mapping("instruction", ("instruction", "output"), (("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction with input", ("input", "instruction", "output"), (("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("system, instruction", ("instruction", "output", "system"), (("system", "system"), ("user", "instruction"), ("assistant", "output"))),
    Mapping("messages", ("messages", "messages[].content", "messages[].role"), items=("messages", "role", "content")),
    Mapping("conversations", ("conversations", "conversations[].from", "conversations[].value"), items=("conversations", "from", "value")),
    Mapping("nested prompt", ("data", "data.prompt", "data.response"), (("user", "data.prompt"), ("assistant", "data.response"))),
)


def fingerprint(paths: tuple[str, ...] | list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def paths_of(kind: DataType, at: str = "") -> list[str]:
    """Nested field paths of a schema."""
    if isinstance(kind, ArrayType):
        return paths_of(kind.elementType, f"{at}[]")
    if isinstance(kind, StructType):
        return [p for f in kind.fields for p in (f"{at}.{f.name}".lstrip("."), *paths_of(f.dataType, f"{at}.{f.name}".lstrip(".")))]
    return []


def json_schema(mapping: Mapping) -> str:
    """DDL to read a record of this layout, all leaves as text."""
    if mapping.items:
        listed, role, text = mapping.items
        return f"`{listed}` array<struct<`{role}`:string,`{text}`:string>>"
    tops: dict[str, list[str]] = {}
    for p in mapping.paths:
        top, _, rest = p.partition(".")
        tops.setdefault(top, []).extend([rest] if rest else [])
    return ", ".join(f"`{t}` " + (f"struct<{','.join(f'`{r}`:string' for r in rest)}>" if rest else "string") for t, rest in tops.items())


def record_fingerprint(record: Column) -> Column:
    """Fingerprint of a JSON text: what the variant's schema says about its field paths."""
    # only objects of the registered depths matter: top fields, and fields of one object or list below
    tops = F.json_object_keys(record)
    below = F.transform(
        tops,
        lambda k: F.when(
            F.substring(F.ltrim(_at(record, k)), 1, 1) == "{", F.transform(F.json_object_keys(_at(record, k)), lambda x: F.concat(k, F.lit("."), x))
        ).when(
            F.substring(F.ltrim(_at(record, k)), 1, 1) == "[",
            F.flatten(F.transform(F.coalesce(F.from_json(_at(record, k), "array<string>"), F.array()), lambda e: F.transform(F.coalesce(F.json_object_keys(e), F.array()), lambda x: F.concat(k, F.lit("[]."), x)))),
        ),
    )
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(F.concat(tops, F.flatten(F.transform(below, lambda b: F.coalesce(b, F.array())))))), "\n"), 256)


def _at(record: Column, key: Column) -> Column:
    return F.element_at(F.from_json(record, "map<string,string>"), key)


def canonical_turns(record: Column, mappings: tuple[Mapping, ...] = MAPPINGS) -> Column:
    """Turns of a JSON record by the mapping that its fingerprint selects; null where there is none."""
    print_of = record_fingerprint(record)
    out = F.lit(None).cast(TURNS)
    for m in mappings:
        if m.items and not m.items[0]:
            continue
        read = F.from_json(record, json_schema(m))
        if m.items:
            turns = F.transform(read[m.items[0]], partial(_item, m))
        else:
            texts = []
            for role, path in m.turns:
                c = read
                for part in path.split("."):
                    c = c[part]
                texts.append(_turn(F.lit(role), c))
            turns = F.array(*texts)
            if len(m.turns) > 2:
                turns = F.filter(turns, lambda t: t["text"] != "")
        out = F.when(print_of == fingerprint(m.paths), turns).otherwise(out)
    return out


def _renamed(role: Column, m: Mapping) -> Column:
    role = F.coalesce(role, F.lit(""))
    for old, new in m.roles:
        role = F.when(role == old, F.lit(new)).otherwise(role)
    return role


def _item(m: Mapping, x: Column) -> Column:
    _, role, text = m.items
    return _turn(_renamed(x[role], m), x[text])


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


#: What a layout's fingerprint is made from: field paths that some mapping names.
KNOWN_PATHS = frozenset(p for m in MAPPINGS for p in m.paths)
BY_FINGERPRINT = {fingerprint(m.paths): m for m in MAPPINGS}


def turn_rows(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """(conv_col, turns) of a table whose rows are turns; the fingerprint of its schema selects the mapping.

    Columns that no mapping names are no part of the fingerprint.  Where columns of other layouts stand beside
    those of turn rows, so that nothing has the fingerprint, the table is still read as turn rows.
    """
    have = [p for p in paths_of(df.schema) if p in KNOWN_PATHS]
    m = BY_FINGERPRINT.get(fingerprint(have)) or next((m for m in MAPPINGS if m.items and not m.items[0] and set(m.paths) <= set(have)), None)
    if m is None or not m.items or m.items[0]:
        raise ValueError("the fingerprint of this schema selects no mapping of turn rows")
    _, role, text = m.items
    row = F.struct(F.col(turn_col), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    rows = df.groupBy(conv_col).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return rows.select(conv_col, F.transform("rows", lambda r: F.struct(r["role"], r["text"])).alias("turns"))


# ---- formatting -------------------------------------------------------------------------------


def formatted(turns: Column) -> Column:
    one = lambda t: F.concat(F.lit(START), F.replace(escape(t["role"]), F.lit("\n"), F.lit("\\n")), F.lit("\n"), escape(t["text"]), F.lit(END))
    return F.array_join(F.transform(turns, one), "")


def format_chats(df: DataFrame, turns_col: str = "turns") -> DataFrame:
    """df with formatted and loss_mask in place of its turns.

    loss_mask: code point ranges [start, end) of the formatted text that the loss covers, the assistant's texts.
    Columns of those two names give way.
    """
    turns = F.col(turns_col)
    role = lambda t: F.length(F.replace(escape(t["role"]), F.lit("\n"), F.lit("\\n")))
    sizes = F.transform(turns, lambda t: F.struct((role(t) + (len(START) + 1)).alias("lead"), F.length(escape(t["text"])).alias("chars"), (t["role"] == "assistant").alias("own")))
    packed = df.select(F.struct("*").alias("row"), formatted(turns).alias("formatted"), sizes.alias("sizes"))
    packed = running(packed, {"at": F.transform("sizes", lambda x: x["lead"] + x["chars"] + len(END))})
    own = F.filter(F.arrays_zip(F.col("sizes").alias("x"), F.col("at").alias("at")), lambda r: r["x"]["own"])
    mask = F.transform(own, lambda r: F.struct((r["at"] + r["x"]["lead"]).alias("start"), (r["at"] + r["x"]["lead"] + r["x"]["chars"]).alias("end")))
    kept = [c for c in df.columns if c not in (turns_col, "formatted", "loss_mask")]
    return packed.select(*(F.col("row").getField(c).alias(c) for c in kept), "formatted", mask.alias("loss_mask"))


def read_back(text: Column) -> Column:
    """The turns (role, text) of a formatted text."""
    parts = F.filter(F.split(text, re.escape(END)), lambda p: p != "")
    body = F.transform(parts, lambda p: F.substring(p, len(START) + 1, 2147483647))
    split = F.transform(body, lambda b: F.struct(F.substring_index(b, "\n", 1).alias("role"), b.alias("all")))
    return F.transform(split, lambda s: F.struct(unescape(s["role"]).alias("role"), unescape(F.substring(s["all"], F.length(s["role"]) + 2, F.lit(2147483647))).alias("text")))


def digests(df: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What a reader of (conv_col, formatted, loss_mask) finds: counts and digests of turns and of text under the mask."""
    read = df.select(conv_col, "formatted", "loss_mask", read_back(F.col("formatted")).alias("read"), utf32(F.col("formatted")).alias("whole"))
    loss = F.array_join(F.transform("loss_mask", lambda r: unescape(between(F.col("whole"), r["start"], r["end"]))), "")
    whole = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    counted = read.select(conv_col, F.size("read").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return counted.select(conv_col, "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
