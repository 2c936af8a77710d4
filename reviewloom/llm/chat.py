"""Chat formatting: records of unlike layouts become canonical turns, then one marked text with a loss mask.

A record's schema fingerprint is the hash of its nested field paths; it selects a declarative mapping to turns.  Fields
beside the paths of a layout are optional, but for fields in which another layout keeps texts.  The
template writes ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn.  In roles and texts a backslash is doubled and ``<|``
becomes ``<\\|`` (in roles a line end becomes ``\\n``), so that control strings inside texts cannot be taken for marks
and reading back gives the very texts.  The loss mask is the places of assistant texts, in code points.

Odd input: null texts and roles are empty; turns order by turn, role, text, nulls first; repeated rows are turns of
their own; a null conversation id is one conversation; a record that is no object, or of an unknown layout, has the
layout ``unknown`` and no turns, and stays whole in the column ``unmapped``; an empty table gives no rows.  One conversation is one row, so it must fit a row.
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"

#: Layout, its field paths, and how they become turns: fixed roles with the fields of their text, or a list of
#: messages with the fields of role and text, and names of roles.
LAYOUTS = {
    "prompt_response": (["prompt", "response"], {"turns": [("user", ["prompt"]), ("assistant", ["response"])]}),
    "prompt_completion": (["prompt", "completion"], {"turns": [("user", ["prompt"]), ("assistant", ["completion"])]}),
    "question_answer": (["question", "answer"], {"turns": [("user", ["question"]), ("assistant", ["answer"])]}),
    "instruction": (["instruction", "output"], {"turns": [("user", ["instruction"]), ("assistant", ["output"])]}),
    "instruction_input": (["instruction", "input", "output"], {"turns": [("user", ["instruction", "input"]), ("assistant", ["output"])]}),
    "instruction_system": (["system", "instruction", "output"], {"turns": [("system", ["system"]), ("user", ["instruction"]), ("assistant", ["output"])]}),
    "messages": (["messages[].role", "messages[].content"], {"each": "messages", "role": "role", "text": "content"}),
    "nested_messages": (["data.messages[].role", "data.messages[].content"], {"each": "data.messages", "role": "role", "text": "content"}),
    "shared_dialogue": (
        ["conversations[].from", "conversations[].value"],
        {"each": "conversations", "role": "from", "text": "value", "names": {"human": "user", "gpt": "assistant"}},
    ),
}


def paths(value, at: str = "") -> set[str]:
    """Field paths of a nested value; ``[]`` stands for the members of a list."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in paths(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list):
        return {p for v in value for p in paths(v, at + "[]")} or {at + "[]"}
    return {at}


def fingerprint(names) -> str:
    return hashlib.blake2b("\n".join(sorted(names)).encode(), digest_size=8).hexdigest()


MAPPINGS = {fingerprint(names): (layout, mapping) for layout, (names, mapping) in LAYOUTS.items()}
#: Outermost fields in which a layout keeps texts.
FIELDS = {layout: {re.split(r"[.\[]", n)[0] for n in names} for layout, (names, _) in LAYOUTS.items()}
TEXT_FIELDS = set().union(*FIELDS.values())


def mapping_of(names: set[str]) -> tuple[str, dict | None]:
    """The layout whose paths are all there and whose fields are all of the text fields that are there."""
    there = TEXT_FIELDS & {re.split(r"[.\[]", n)[0] for n in names}
    for layout, (needed, mapping) in LAYOUTS.items():
        if FIELDS[layout] == there and names.issuperset(needed):
            return layout, mapping
    return "unknown", None


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def canonical(record: str | None) -> tuple[str, str, list[tuple[str, str]]]:
    """Fingerprint, layout and turns of one record."""
    try:
        value = json.loads(record or "null")
    except ValueError:
        value = None
    names = paths(value)
    mark = fingerprint(names)
    layout, mapping = MAPPINGS.get(mark) or mapping_of(names)
    if not isinstance(value, dict) or mapping is None:
        return mark, "unknown", []
    if "turns" in mapping:
        return mark, layout, [(role, "\n\n".join(t for t in (_text(value[f]) for f in fields) if t)) for role, fields in mapping["turns"]]
    for step in mapping["each"].split("."):
        value = value.get(step) if isinstance(value, dict) else None
    if not isinstance(value, list) or not all(isinstance(m, dict) for m in value):
        return mark, "unknown", []
    renamed = mapping.get("names", {})
    return mark, layout, [(renamed.get(r, r), _text(m.get(mapping["text"]))) for m in value for r in [_text(m.get(mapping["role"]))]]


def escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def formatted(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The marked text and the places of assistant texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escaped(role)}".replace("\n", "\\n") + "\n", escaped(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def read_turns(text: str) -> list[tuple[str, str]]:
    """The turns of a marked text."""
    out = []
    for part in text.split(OPEN)[1:]:
        role, _, body = part.partition("\n")
        out.append((unescaped(role), unescaped(body[:body.index(CLOSE)])))
    return out


FORMATTED = "fingerprint string, layout string, formatted string, loss_spans array<struct<start:bigint,end:bigint>>, unmapped string"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def format_chats(records: DataFrame, id_col: str = "conv_id", record_col: str = "record") -> DataFrame:
    """id, fingerprint, layout, formatted text and loss_spans of JSON records; unmapped is a record of unknown layout."""
    kind = records.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):  # a row at a time: conversations may be long
                record = b.column(1)[i].as_py()
                mark, layout, turns = canonical(record)
                text, spans = formatted(turns)
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(i, 1), pa.array([mark]), pa.array([layout]), pa.array([text]), pa.array([[{"start": s, "end": e} for s, e in spans]], _SPANS),
                    pa.array([record if layout == "unknown" else None], pa.string()),
                ], names=["id", "fingerprint", "layout", "formatted", "loss_spans", "unmapped"])

    return _packed(records.select(F.col(id_col).alias("id"), record_col), run, f"id {kind}, {FORMATTED}").withColumnRenamed("id", id_col)


def read_chats(chats: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """id, turns, loss_text and formatted_chars read from formatted texts and their loss masks."""
    kind = chats.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                text = b.column(1)[i].as_py() or ""
                loss = "".join(unescaped(text[s["start"]:s["end"]]) for s in b.column(2)[i].as_py() or [])
                turns = [{"role": r, "text": t} for r, t in read_turns(text)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([turns], _TURNS), pa.array([loss]), pa.array([len(text)])], names=["id", "turns", "loss_text", "formatted_chars"])

    out = _packed(chats.select(F.col(id_col).alias("id"), "formatted", "loss_spans"), run, f"id {kind}, turns array<struct<role:string,text:string>>, loss_text string, formatted_chars long")
    return out.withColumnRenamed("id", id_col)


def _packed(df: DataFrame, run, schema: str, rows: int = 256, size: int = 4 << 20) -> DataFrame:
    """mapInArrow with the small batches that ``run`` yields put together again."""
    def packed(batches):
        held, much = [], 0
        for b in run(batches):
            held.append(b)
            much += b.nbytes
            if len(held) >= rows or much >= size:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, much = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return df.mapInArrow(packed, schema)


def unmapped(chats: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """The records of unknown layout among formatted chats, whole, with their fingerprints."""
    return chats.where(F.col("layout") == "unknown").select(id_col, "fingerprint", F.col("unmapped").alias("record"))


def records_of(turns: DataFrame) -> DataFrame:
    """One JSON record per conversation (conv_id, turn, role, text), dealt by id to the layouts that its roles allow.

    Some records have fields beside those of their layout, and some messages a name.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", text("role"), text("text")))).alias("t"))
    roles, at = F.col("t.role"), lambda i, name: F.col("t")[i]["text"].alias(name)
    named = lambda t: F.when(t["role"] == "user", "human").when(t["role"] == "assistant", "gpt").otherwise(t["role"])
    extra = F.when(F.pmod(F.xxhash64(F.lit("extra"), "conv_id"), F.lit(2)) == 0, "conversations").alias("source")
    name = lambda t: F.when((t["turn"] % 2 == 0) & extra.isNotNull(), "name").alias("name")
    record = lambda *fields: F.to_json(F.struct(*fields, extra))  # noqa: E731  null fields are left out
    listed = lambda role, body: F.transform("t", lambda t: F.struct((named(t) if role == "from" else t["role"]).alias(role), t["text"].alias(body), name(t)))
    # an instruction and its input are read back with an empty line between them
    said = F.col("t")[0]["text"]
    start = F.substring_index(said, "\n\n", 1)
    rest = F.substring(said, F.length(start) + 3, F.length(said))
    parted = (start != "") & (rest != "")
    messages = [record(listed("role", "content").alias("messages")), record(F.struct(listed("role", "content").alias("messages")).alias("data"))]
    known = [*messages, record(listed("from", "value").alias("conversations"))]
    pair = [
        *known, record(at(0, "prompt"), at(1, "response")), record(at(0, "prompt"), at(1, "completion")), record(at(0, "question"), at(1, "answer")),
        record(at(0, "instruction"), at(1, "output")),
        record(F.when(parted, start).otherwise(said).alias("instruction"), F.when(parted, rest).otherwise("").alias("input"), at(1, "output")),
    ]
    system = [*known, record(at(0, "system"), at(1, "instruction"), at(2, "output"))]

    def dealt(kinds: list):
        place, out = F.pmod(F.xxhash64(F.lit("layout"), "conv_id"), F.lit(len(kinds))), kinds[-1]
        for k, kind in enumerate(kinds[:-1]):
            out = F.when(place == k, kind).otherwise(out)
        return out

    of = lambda *names: roles == F.array(*map(F.lit, names))
    chosen = (
        F.when(of("user", "assistant"), dealt(pair)).when(of("system", "user", "assistant"), dealt(system))
        .when(F.forall(roles, lambda r: r.isin("system", "user", "assistant")), dealt(known)).otherwise(dealt(messages))
    )
    return rows.select("conv_id", chosen.alias("record"))
