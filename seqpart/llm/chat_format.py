"""Chat formatting: records of any known layout become canonical turns, and turns become one marked-up string.

A record's nested field paths are hashed; the hash selects a declarative mapping. Everything is a Column expression.

Defined results: a null field counts as absent, unknown fields are ignored; a record whose set of known paths has no mapping
gives null turns; null roles and texts are empty; an empty list of turns formats to an empty string. Turns of a table of
rows are ordered by (turn, role, text), so ties and repeated rows keep a fixed order and all stay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind

# The markers of the template.
START, END = "<|im_start|>", "<|im_end|>"
# Role names of the layout of from/value pairs and their canonical names. Other layouts keep the names they give.
ROLE_NAMES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
# Every field that a known layout uses; records are brought to this shape, other fields are ignored.
RECORD = ("messages array<struct<role string, content string>>, conversations array<struct<`from` string, `value` string>>, "
          "system string, prompt string, completion string, response string, instruction string, input string, output string, "
          "question string, answer string")
TURN = "array<struct<role string, text string>>"


@dataclass(frozen=True)
class Layout:
    """Field paths of a layout and where its turns come from.

    ``listed`` is (list, role field, text field); ``fixed`` lists (role, fields joined by a blank line); ``names`` maps the
    layout's own role names.
    """

    paths: tuple[str, ...]
    listed: tuple[str, str, str] | None = None
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()
    names: tuple[tuple[str, str], ...] = ()


def _pair(asked: tuple[str, ...], answer: str, system: bool) -> Layout:
    head = (("system", ("system",)),) if system else ()
    return Layout((*asked, answer, *(("system",) if system else ())), fixed=(*head, ("user", asked), ("assistant", (answer,))))


LAYOUTS = [
    Layout(("messages[].role", "messages[].content"), listed=("messages", "role", "content")),
    Layout(("conversations[].from", "conversations[].value"), listed=("conversations", "from", "value"), names=tuple(ROLE_NAMES.items())),
    *(_pair(asked, answer, system) for system in (False, True) for asked, answer in (
        (("prompt",), "completion"), (("prompt",), "response"), (("instruction",), "output"), (("instruction", "input"), "output"),
        (("instruction",), "response"), (("question",), "answer"))),
]


def _present(record: Column, path: str) -> Column:
    if "[]." in path:
        outer, inner = path.split("[].")
        return F.coalesce(F.exists(record[outer], lambda e: e[inner].isNotNull()), F.lit(False))
    return record[path].isNotNull()


def _known_paths(layouts: list[Layout]) -> list[str]:
    return sorted({p for layout in layouts for p in layout.paths})


def fingerprint(record: Column, layouts: list[Layout] = LAYOUTS) -> Column:
    """Hash of the sorted known field paths that a record holds."""
    held = [F.when(_present(record, p), F.lit(p)) for p in _known_paths(layouts)]
    return F.xxhash64(F.concat_ws("\n", *held))


def canonical_turns(record: Column, layouts: list[Layout] = LAYOUTS) -> Column:
    """Turns (role, text) of a record by the mapping that its fingerprint selects; null where there is none."""

    def role(name: Column, names: tuple[tuple[str, str], ...]) -> Column:
        out = name
        for other, own in names:
            out = F.when(name == other, F.lit(own)).otherwise(out)
        return F.coalesce(out, F.lit(""))

    def turns(layout: Layout) -> Column:
        if layout.listed:
            items, who, what = layout.listed
            made = F.transform(record[items], lambda e: F.struct(role(e[who], layout.names).alias("role"), F.coalesce(e[what], F.lit("")).alias("text")))
        else:
            made = F.array(*(F.struct(F.lit(r).alias("role"), F.concat_ws("\n\n", *(record[f] for f in fields)).alias("text"))
                             for r, fields in layout.fixed))
        return made.cast(TURN)

    def chosen(mark: Column) -> Column:
        out = F.lit(None).cast(TURN)
        for layout in layouts:
            wanted = F.xxhash64(F.lit("\n".join(sorted(layout.paths))))
            out = F.when(mark == wanted, turns(layout)).otherwise(out)
        return out

    return bind(fingerprint(record, layouts), chosen)


def json_record(text: Column) -> Column:
    """A JSON record in the common shape; fields of another type than the layouts' are null."""
    return F.from_json(text, RECORD)


def frame_record(df: DataFrame) -> Column:
    """A frame's own columns in the common shape; further columns are ignored."""
    shape = F.struct(*(df[f"`{c}`"].alias(c) for c in dict.fromkeys(df.columns)))
    return F.from_json(F.to_json(shape), RECORD)


def _escaped(text: Column, line: bool = False) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    if line:
        out = F.replace(out, F.lit("\n"), F.lit("\\n"))
    return F.replace(out, F.lit("<|"), F.lit("<\\|"))


def _unescaped(text: Column, line: bool = False) -> Column:
    def piece(p: Column) -> Column:
        p = F.replace(p, F.lit("\\|"), F.lit("|"))
        return F.replace(p, F.lit("\\n"), F.lit("\n")) if line else p

    return F.array_join(F.transform(F.split(text, r"\\\\"), piece), "\\")


def formatted(turns: Column) -> Column:
    """The string of a conversation. Control strings inside roles and texts are escaped, so markers are only the template's."""
    return F.array_join(F.transform(turns, lambda t: F.concat(
        F.lit(START), _escaped(t["role"], line=True), F.lit("\n"), _escaped(t["text"]), F.lit(END + "\n"))), "")


_TURN = r"(?s)<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n"


def parsed(text: Column) -> Column:
    """Turns (role, text, loss) read back from a formatted string; ``loss`` marks what is trained on: the assistant's texts."""
    roles = F.regexp_extract_all(text, F.lit(_TURN), F.lit(1))
    texts = F.regexp_extract_all(text, F.lit(_TURN), F.lit(2))
    return F.zip_with(roles, texts, lambda r, t: F.struct(
        _unescaped(r, line=True).alias("role"), _unescaped(t).alias("text"), (r == "assistant").alias("loss")))


def loss_spans(text: Column) -> Column:
    """(start, length) in characters of each trained part of a formatted string, escapes included."""
    roles = F.regexp_extract_all(text, F.lit(_TURN), F.lit(1))
    texts = F.regexp_extract_all(text, F.lit(_TURN), F.lit(2))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start long, length long>>").alias("spans"))

    def step(acc: Column, turn: Column) -> Column:
        start = acc["at"] + len(START) + F.length(turn["role"]) + 1
        size = F.length(turn["text"]).cast("long")
        span = F.array(F.struct(start.alias("start"), size.alias("length")))
        return F.struct((start + size + len(END) + 1).alias("at"),
                        F.when(turn["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(F.zip_with(roles, texts, lambda r, t: F.struct(r.alias("role"), t.alias("text"))), zero, step, lambda a: a["spans"])


def rows_as_records(rows: DataFrame) -> DataFrame:
    """One record (conv_id, record) per conversation from a table with a row per turn."""
    kept = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = kept.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("rows"))
    messages = F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("content")))
    shape = F.from_json(F.lit("{}"), RECORD)
    return grouped.select("conv_id", shape.withField("messages", messages).alias("record"))


def digests(text: Column) -> list[Column]:
    """What the formatted strings hold, read back from them."""
    turns = parsed(text)
    loss = bind(turns, lambda ts: F.array_join(F.transform(F.filter(ts, lambda t: t["loss"]), lambda t: t["text"]), ""))
    whole = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return [
        F.size(turns).cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length(text).cast("long").alias("formatted_chars"),
    ]
