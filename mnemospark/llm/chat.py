"""Chat records of any known layout as turns, and turns as marked text with a loss mask.

A layout is told by the fingerprint of its nested field paths: paths that no mapping
knows are set aside, the others are sorted and hashed, and the hash finds a declarative
mapping to turns (role, text). That works on the schema of a table, where one row is
one turn or one record, and on single JSON records of mixed layouts. Records of unknown
fingerprint give no turns and can be listed with their fingerprint.

The text form of a turn is "<|role|>", a line feed, its text and "<|end|>" with a line
feed. In texts a backslash becomes two and "<|" becomes "\\l|", so no text can hold a
mark; in roles "|" and line feeds are escaped too. Both are undone on reading. The mask
covers what assistants say, mark excluded.

Turns are formatted in place. A conversation's turns then stream through one task in
order; nothing of a conversation is gathered, so its length is bounded by no memory.
Text form is written in parts of whole turns, with the mask as spans within each part.

Defined results: null texts and roles count as empty; turns of equal number are ordered
by role and text; repeated rows are turns of their own; null conversation ids are one
conversation; null turn numbers come first; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from mnemospark.llm.arrow import arrow_map, column
from mnemospark.plans.lineage import cut

#: Characters after which a part is closed.
PART = 200_000
END = "<|end|>\n"

# The mappings. "rows" takes one turn from each row; "each" walks an array
# of turns; "take" lists fixed turns, whose texts join the given fields. "?" marks a
# field that may be missing.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}
MAPPINGS = {
    "turn rows": {"rows": {"conversation": "conv_id", "turn": "turn", "role": "role", "text": "text"}},
    "messages": {"each": "messages", "role": "role", "text": "content", "first": [("system", ["system?"])]},
    "conversations": {"each": "conversations", "role": "from", "text": "value", "first": [("system", ["system?"])]},
    "dialogue": {"each": "dialogue", "role": "speaker", "text": "text", "first": []},
    "instruction": {"take": [("system", ["system?"]), ("user", ["instruction", "input?"]), ("assistant", ["output"])]},
    "prompt": {"take": [("system", ["system?"]), ("user", ["prompt"]), ("assistant", ["completion"])]},
    "prompt and response": {"take": [("system", ["system?"]), ("user", ["prompt"]), ("assistant", ["response"])]},
    "question": {"take": [("user", ["context?", "question"]), ("assistant", ["answer"])]},
}


def _paths(mapping: dict) -> tuple[set[str], set[str]]:
    """The field paths that a mapping needs and those it may use."""
    if "rows" in mapping:
        return set(mapping["rows"].values()), set()
    fields = [f for _, fs in mapping.get("take", mapping.get("first")) for f in fs]
    need, may = {f for f in fields if f[-1] != "?"}, {f[:-1] for f in fields if f[-1] == "?"}
    if "each" in mapping:
        need |= {f"{mapping['each']}[].{mapping[k]}" for k in ("role", "text")}
    return need, may


KNOWN = set().union(*(a | b for a, b in map(_paths, MAPPINGS.values())))


def fingerprint(paths: set[str]) -> str:
    """Hash of the known ones of a layout's field paths."""
    return hashlib.sha1("\n".join(sorted(paths & KNOWN)).encode()).hexdigest()[:16]


def _table() -> dict[str, str]:
    out: dict[str, str] = {}
    for name, mapping in MAPPINGS.items():
        need, may = _paths(mapping)
        options = sorted(may)
        for k in range(1 << len(options)):
            found = fingerprint(need | {o for i, o in enumerate(options) if k >> i & 1})
            if out.setdefault(found, name) != name:
                raise ValueError(f"{name} and {out[found]} have one fingerprint")
    return out


BY_FINGERPRINT = _table()


def schema_paths(kind: DataType, before: str = "") -> set[str]:
    """Nested field paths of a table's schema."""
    if isinstance(kind, StructType):
        return set().union(*(schema_paths(f.dataType, f"{before}.{f.name}" if before else f.name) for f in kind)) if kind.fields else set()
    return schema_paths(kind.elementType, f"{before}[]") if isinstance(kind, ArrayType) else {before}


def json_paths(value: object, before: str = "") -> set[str]:
    """Nested field paths of a JSON value; fields that are null count as missing."""
    if isinstance(value, dict):
        return set().union(*(json_paths(v, f"{before}.{k}" if before else k) for k, v in value.items())) if value else set()
    if isinstance(value, list):
        return set().union(*(json_paths(v, f"{before}[]") for v in value)) if value else set()
    return set() if value is None else {before}


def _text(value: object) -> str:
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)


def record_turns(record: object) -> tuple[str, list[tuple[str, str]]]:
    """Fingerprint and turns of one JSON record."""
    found = fingerprint(json_paths(record))
    mapping = MAPPINGS.get(BY_FINGERPRINT.get(found, ""))
    if mapping is None or "rows" in mapping or not isinstance(record, dict):
        return found, []
    turns = [(role, "\n\n".join(t for f in fields if (t := _text(record.get(f.rstrip("?")))))) for role, fields in mapping.get("take", mapping.get("first"))]
    turns = [(r, t) for (r, t), (_, fields) in zip(turns, mapping.get("take", mapping.get("first")), strict=True) if t or any(f[-1] != "?" for f in fields)]
    for x in record[mapping["each"]] if "each" in mapping else ():
        if isinstance(x, dict):
            role = _text(x.get(mapping["role"]))
            turns.append((ROLES.get(role, role), _text(x.get(mapping["text"]))))
    return found, turns


def turns_of_records(records: DataFrame, record_id: str, record: str) -> DataFrame:
    """(conv_id, fingerprint, turn, role, text) of JSON records; turn is null for a record without a known layout."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    found, turns = record_turns(json.loads(source)) if source else (fingerprint(set()), [])
                except ValueError:
                    found, turns = "invalid", []
                rows += [(i, found, k, r, t) for k, (r, t) in enumerate(turns)] or [(i, found, None, None, None)]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["conv_id", "fingerprint", "turn", "role", "text"])

    return arrow_map(records.select(F.col(record_id).cast("long"), record), run, "conv_id long, fingerprint string, turn long, role string, text string")


def turns_of_table(df: DataFrame, record_id: str = "conv_id") -> DataFrame:
    """(conv_id, turn, role, text) of a table whose schema's fingerprint names its mapping.

    Of turn rows roles stay as they are. Of a table with one typed record a row, nested
    arrays and structs included, the records go the way of JSON records, with their
    conversation id in ``record_id``; a row whose needed field is null gives no turns.
    """
    paths = schema_paths(df.schema)
    # the id is a field of turn rows, but of no record
    name = BY_FINGERPRINT.get(fingerprint(paths)) or BY_FINGERPRINT.get(fingerprint(paths - {record_id}))
    if name is None:
        raise ValueError(f"no mapping for a table with {sorted(paths)}")
    if "rows" not in MAPPINGS[name]:
        fields = sorted({p.split("[")[0].split(".")[0] for p in set().union(*_paths(MAPPINGS[name]))} & set(df.columns))
        records = df.select(column(record_id).cast("long").alias("id"), F.to_json(F.struct(*map(column, fields))).alias("record"))
        return turns_of_records(records, "id", "record").where("turn is not null").select("conv_id", "turn", "role", "text")
    of = MAPPINGS[name]["rows"]
    return df.select(F.col(of["conversation"]).alias("conv_id"), F.col(of["turn"]).alias("turn"), F.coalesce(F.col(of["role"]), F.lit("")).alias("role"), F.coalesce(F.col(of["text"]), F.lit("")).alias("text"))


def _escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("\\l|"))


def _escape_role(c: Column) -> Column:
    return F.replace(F.replace(_escape(c), F.lit("|"), F.lit("\\p")), F.lit("\n"), F.lit("\\n"))


_PLAIN = {"\\": "\\", "l": "<", "p": "|", "n": "\n"}
_TURN = re.compile(r"<\|((?:[^|\n])*)\|>\n(.*?)<\|end\|>\n", re.S)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _PLAIN[m[1]], text) if "\\" in text else text


def parse(text: str) -> list[tuple[str, str]]:
    """Roles and texts of whole turns in text form."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(text)]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of sorted batches as tuples."""
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def format_turns(turns: DataFrame) -> DataFrame:
    """Text form: (conv_id, part, text, mask), where mask has the spans of the part that are trained on."""
    shaped = turns.select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.concat(F.lit("<|"), _escape_role(F.col("role")), F.lit("|>\n")).alias("head"),
        _escape(F.col("text")).alias("body"),
        (F.col("role") == "assistant").alias("trained"),
    )
    ordered = shaped.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "head", "body", "trained")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held: list[str] = []
        mask: list[dict[str, int]] = []
        now, part, size, waiting = None, 0, 0, 0
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

        def emit() -> pa.RecordBatch:
            out = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], kind)]
            rows.clear()
            return pa.RecordBatch.from_arrays(out, ["conv_id", "part", "text", "mask"])

        def close() -> None:
            nonlocal part, size, waiting
            if held:
                rows.append((now, part, "".join(held), list(mask)))
                waiting += size
            held.clear(), mask.clear()
            part, size = part + 1, 0

        for conv, head, body, trained in _runs(batches):
            if held and conv != now:
                close()
                part = 0
            elif size >= PART:
                close()
            if conv != now:
                part = 0
            now = conv
            if trained:
                mask.append({"start": size + len(head), "end": size + len(head) + len(body)})
            held += (head, body, END)
            size += len(head) + len(body) + len(END)
            if waiting > 10 * PART:
                yield emit()
                waiting = 0
        close()
        yield emit()

    return cut(arrow_map(ordered, run, "conv_id long, part long, text string, mask array<struct<start:long,end:long>>"), "chat")


def digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read from its text form: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)."""
    ordered = formatted.select("conv_id", "part", "text", "mask").repartition("conv_id").sortWithinPartitions("conv_id", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        state: list | None = None

        def done() -> None:
            if state is not None:
                rows.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        def emit() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            out = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            rows.clear()
            return pa.RecordBatch.from_arrays(out, ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for conv, _, text, mask in _runs(batches):
            if state is None or state[0] != conv:
                done()
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, said in parse(text):
                state[1] += 1
                state[2].update(f"{role}\n{said}\n".encode())
            for m in mask:
                said = unescape(text[m["start"] : m["end"]])
                state[3] += len(said)
                state[4].update(said.encode())
            state[5] += len(text)
            if len(rows) >= 1 << 13:
                yield emit()
        done()
        yield emit()

    return arrow_map(ordered, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
