"""Personal data: patterns, and terms that give a found entity away.

Patterns find e-mail addresses, IP addresses, card numbers and phone numbers in whole
texts. Then the corpus says which terms disclose an entity. Terms are runs of at least
three letters and digits outside of all found spans, lower-cased. With N texts, df texts
that hold a term or an entity and co texts that hold both, anywhere in their whole texts,
the point-wise mutual information ln(co N / (df_term df_entity)) is taken as a share of
the entity's information content -ln(df_entity / N). The share is 1 for a term that is
never seen without the entity and near 0 for common words. Terms seen with an entity in at
least SUPPORT texts are generalised (to the mark of their form: NUMBER for one with a
digit, NAME for one that begins with a capital, else WORD) from the share GENERALISE on
and removed from REMOVE on, wherever they occur, also in texts without the entity.

All counts cover all texts. Maps of fixed size over hashed entities and terms leave most
of what can't matter out early; they let some through and keep none of the wanted back.
Pairs of an entity and a term are summed before they are shuffled, and the joins on them
can be split.

Defined results: a null text counts as empty, has no spans and stays null where it is
cleaned; repeated rows, and rows with null ids, get a row each and each counts as a text;
columns of the input are kept, but for those named like the two new ones; an entity that
is in every text has no information and no terms; of spans that overlap, the first is
replaced.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.arrow import appended, arrow_map, column, unused
from mnemospark.plans.lineage import cut

# The kinds in their order and their patterns.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Matches start where a run of digits starts, so the look-behind changes no result.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Terms of a text outside of its spans.
WORD = re.compile(r"[^\W_]{3,}")
SUPPORT = 3
GENERALISE, REMOVE = 0.75, 0.95
SLOTS = 1 << 22
#: Partial counts that a task holds before it passes them on.
HELD = 200_000
#: So many flagged terms are sent to the executors, which then need neither a join nor a table of texts.
SENT = 400_000
SPAN = "array<struct<kind:string,start:long,end:long>>"
TERM = "array<struct<term:string,starts:array<long>>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_TERM = pa.list_(pa.struct([("term", pa.string()), ("starts", pa.list_(pa.int64()))]))


def _emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            free = m.end()
            out.append((start, free))
        at = text.find("@", max(at + 1, free))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns' matches, kind by kind, from left to right."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    for m in IP.finditer(text) if "." in text else ():
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def _entity(kind: str, value: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{kind}:{value}".encode(), digest_size=8).digest(), "big", signed=True)


def terms_of(text: str, spans: list[tuple[str, int, int]]) -> dict[str, list[int]]:
    """Lower-cased terms of a text outside of the spans, with the places where they start."""
    out: dict[str, list[int]] = {}
    if not spans:
        for m in WORD.finditer(text):
            out.setdefault(m[0].lower(), []).append(m.start())
        return out
    free, edges = 0, []
    for _, a, b in sorted(spans, key=lambda s: s[1:]):
        edges.append((free, a))
        free = max(free, b)
    for low, high in [*edges, (free, len(text))]:
        # a run that a span cuts is no term
        for m in WORD.finditer(text, low):
            if m.start() >= high:
                break
            if m.end() <= high and not (m.start() and m.start() == low and text[low - 1].isalnum()):
                out.setdefault(m[0].lower(), []).append(m.start())
    return out


def distinct_terms(text: str, spans: list[tuple[str, int, int]]) -> set[str]:
    if spans:
        return set(terms_of(text, spans))
    # lowering first is faster, but a dotted capital I grows when lowered
    return set(WORD.findall(text.lower())) if "İ" not in text else {w.lower() for w in WORD.findall(text)}


class Slots:
    """A map of SLOTS bits over hashes: what was put in is in it, and some more."""

    def __init__(self, hashes: DataFrame) -> None:
        """``hashes``: one column of long values."""
        slot = hashes.select(hashes[0].bitwiseAND(F.lit(SLOTS - 1)).alias("slot"))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot").bitwiseAND(F.lit(63)).cast("int"))
        rows = slot.groupBy(F.shiftrightunsigned("slot", 6).alias("at")).agg(F.bit_or(bit).alias("bits")).collect()  # at most SLOTS / 64 rows
        table = np.zeros(SLOTS // 64, np.int64)
        for r in rows:
            table[r["at"]] = r["bits"]
        self.sent = hashes.sparkSession.sparkContext.broadcast(np.unpackbits(table.view(np.uint8), bitorder="little").tobytes())

    def holds(self, number: int) -> bool:
        return bool(self.sent.value[number & SLOTS - 1])


def _term_hash(term: str) -> Column:
    return F.crc32(F.encode(term, "UTF-8"))


def counted(rows: DataFrame, of: object, names: tuple[str, ...], schema: str) -> DataFrame:
    """Keys that ``of(*values)`` yields for each row, summed by task and then altogether as n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            columns = list(zip(*counts, strict=True)) if counts else [() for _ in names]
            out = pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64() if n == "entity" else pa.string()) for n, c in zip(names, columns, strict=True)), pa.array(list(counts.values()), pa.int64())], [*names, "n"])
            counts.clear()
            return out

        for b in batches:
            for values in zip(*(c.to_pylist() for c in b.columns), strict=True):
                counts.update(of(*values))
                if len(counts) > HELD:
                    yield flush()
        yield flush()

    return arrow_map(rows, run, schema).groupBy(*names).agg(F.sum("n").alias("n"))


def entity_counts(docs: DataFrame, text: str) -> DataFrame:
    """(entity, n): texts that hold each entity."""

    def of(t: str | None) -> set[tuple[int]]:
        return {(_entity(kind, t[a:b]),) for kind, a, b in base_spans(t)} if t else set()

    return counted(docs.select(column(text)), of, ("entity",), "entity long, n long")


def disclosures(docs: DataFrame, text: str = "text", support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """(term, share) of the terms whose largest share for an entity reaches ``generalise``."""
    entities = cut(entity_counts(docs, text).where(F.col("n") >= support).withColumnRenamed("n", "df_entity"), "entities")
    frequent = Slots(entities.select("entity"))

    def pairs_of(t: str | None) -> list[tuple[int, str]]:
        spans = base_spans(t) if t else []
        near = {e for kind, a, b in spans if frequent.holds(e := _entity(kind, t[a:b]))}
        return [(e, w) for w in distinct_terms(t, spans) for e in near] if near else []

    pairs = counted(docs.select(column(text)), pairs_of, ("entity", "term"), "entity long, term string, n long")
    pairs = cut(pairs.where(F.col("n") >= support).withColumnRenamed("n", "co"), "pairs")
    wanted = Slots(pairs.select(_term_hash("term").alias("h")))

    def wanted_of(t: str | None) -> list[tuple[str]]:
        return [(w,) for w in distinct_terms(t, base_spans(t)) if wanted.holds(zlib.crc32(w.encode()))] if t else []

    terms = counted(docs.select(column(text)), wanted_of, ("term",), "term string, n long").withColumnRenamed("n", "df")
    n = F.lit(float(docs.count()))
    share = F.try_divide(F.log(F.col("co") * n / (F.col("df") * F.col("df_entity"))), -F.log(F.col("df_entity") / n))
    scored = pairs.join(entities, "entity").join(terms, "term").withColumn("share", share)
    return scored.where(F.col("share") >= generalise).groupBy("term").agg(F.max("share").alias("share"))


def find(docs: DataFrame, text: str, spans: str, hits: str, flagged: Slots) -> DataFrame:
    """``docs`` with its base spans and the terms that may be flagged appended; no shuffle."""
    kept = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, near = [], []
            for t in b.column(text).to_pylist():
                base = base_spans(t) if t else []
                some = {w for w in distinct_terms(t, base) if flagged.holds(zlib.crc32(w.encode()))} if t else set()
                found.append([{"kind": k, "start": s, "end": e} for k, s, e in base])
                near.append([{"term": w, "starts": at} for w, at in terms_of(t, base).items() if w in some] if some else [])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(found, _SPAN), pa.array(near, _TERM)], [*kept, spans, hits])

    return arrow_map(docs, run, appended(docs.schema, {spans: SPAN, hits: TERM}))


def mark(word: str) -> str:
    """What a term is generalised to."""
    return "[NUMBER]" if any(c.isdigit() for c in word) else "[NAME]" if word[0].isupper() else "[WORD]"


def hidden(text: str | None, base: list[tuple[str, int, int]], own: list[tuple[int, int, bool]]) -> str | None:
    """A text with its base spans and the terms ``own`` (start, end, whether it is removed) replaced, the first of those that overlap."""
    cuts = [(start, end, f"[{kind.upper()}]") for kind, start, end in base] + [(start, end, "" if removed else mark(text[start:end])) for start, end, removed in own]
    if not cuts:
        return text
    out, at = [], 0
    for start, end, put in sorted(cuts):
        if start >= at:
            out += [text[at:start], put]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _hide(docs: DataFrame, text: str, spans: str, clean: str, flagged: dict[str, bool]) -> DataFrame:
    """``docs`` with spans and cleaned texts, by flagged terms and whether they are removed; each text is scanned once, nothing is shuffled."""
    kept = docs.columns
    sent = docs.sparkSession.sparkContext.broadcast(flagged)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        removed = sent.value
        for b in batches:
            cleaned, all_ = [], []
            for t in b.column(text).to_pylist():
                base = base_spans(t) if t else []
                own: list[tuple[int, int, bool]] = []
                if t and any(w in removed for w in distinct_terms(t, base)):
                    own = sorted((at, at + len(w), removed[w]) for w, starts in terms_of(t, base).items() if w in removed for at in starts)
                cleaned.append(hidden(t, base, own))
                all_.append([{"kind": k, "start": start, "end": end} for k, start, end in [*base, *(("term", start, end) for start, end, _ in own)]])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(all_, _SPAN), pa.array(cleaned, pa.string())], [*kept, spans, clean])

    return arrow_map(docs, run, appended(docs.schema, {spans: SPAN, clean: "string"}))


def sanitise(docs: DataFrame, text: str = "text", support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE, spans: str = "__spans", clean: str = "__clean") -> DataFrame:
    """``docs`` with its spans (base and term spans, each with its kind) and the text without them appended.

    Up to SENT flagged terms go to the executors. If there are more, texts with nothing to
    hide are scanned and passed on; only the others are written and joined.
    """
    kept = [c for c in docs.columns if c not in (spans, clean)]
    docs = docs.select(*map(column, kept))
    flagged = cut(disclosures(docs, text, support, generalise), "terms")
    if flagged.count() <= SENT:
        return _hide(docs, text, spans, clean, {r.term: r.removed for r in flagged.select("term", (F.col("share") >= remove).alias("removed")).collect()})
    row, hits, terms = (unused(x, docs) for x in ("__row", "__hits", "__terms"))
    scanned = find(docs, text, spans, hits, Slots(flagged.select(_term_hash("term").alias("h"))))
    some = (F.size(column(spans)) > 0) | (F.size(column(hits)) > 0)
    found = cut(scanned.where(some).withColumn(row, F.monotonically_increasing_id()), "pii")
    near = found.select(column(row).alias("row"), F.explode(column(hits)).alias("x")).select("row", "x.term", "x.starts")
    listed = (
        near.join(flagged, "term")
        .select("row", F.explode("starts").alias("start"), F.length("term").alias("size"), "share")
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct(F.lit("term").alias("kind"), "start", (F.col("start") + F.col("size")).alias("end"), (F.col("share") >= remove).alias("removed")))).alias(terms))
        .withColumnRenamed("row", row)
    )
    joined = found.drop(hits).join(listed, row, "left").drop(row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cleaned, all_ = [], []
            for t, base, own in zip(b.column(text).to_pylist(), b.column(spans).to_pylist(), b.column(terms).to_pylist(), strict=True):
                own = [(o["start"], o["end"], o["removed"]) for o in own or []]
                cleaned.append(hidden(t, [(o["kind"], o["start"], o["end"]) for o in base], own))
                all_.append([*base, *({"kind": "term", "start": start, "end": end} for start, end, _ in own)])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(all_, _SPAN), pa.array(cleaned, pa.string())], [*kept, spans, clean])

    rest = scanned.where(~some).select(*map(column, kept), column(spans), column(text).alias(clean))
    return arrow_map(joined, run, appended(docs.schema, {spans: SPAN, clean: "string"})).unionByName(rest)
