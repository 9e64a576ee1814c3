"""Byte-pair encoding and decoding with a transducer of frequent words.

A text is cut at white space; each piece is cut into words by the vocabulary's rules.
A word's ids come from a lexicon, a minimal acyclic automaton over UTF-8 bytes in which
equal suffixes share states and whose arcs carry the number of words passed, so that a
word's path sums to its number and the number finds its ids. The lexicon is one file,
memory-mapped by the workers. Words that it lacks are merged pair by pair by rank,
which gives the ids that the lexicon would hold: it changes speed and never results.

The lexicon is compiled from word counts over all texts. Each task keeps bounded
counters (a Misra-Gries summary, so every word of a share above 1/COUNTERS of its
texts is kept), summaries are added by word, and the LEXICON most counted words,
a bounded number, reach the driver.

Defined results: a null or blank text has no ids and decodes to the empty string;
repeated rows are encoded each; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import re
import tempfile
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mnemospark.llm.arrow import appended, arrow_map, column
from mnemospark.plans.lineage import cut

#: Words compiled into the lexicon.
LEXICON = 1 << 15
#: Counters that a task keeps.
COUNTERS = 1 << 16
#: Pieces, and words, whose ids a worker remembers at most, and characters of texts that are encoded together.
KNOWN, TOGETHER = 300_000, 3_500_000
#: The same where texts are decoded as well; a worker may wait with what it holds while other stages run.
KNOWN_LESS, TOGETHER_LESS = 100_000, 600_000
#: Words longer than this are merged with a heap.
LONG = 48
#: White space by Unicode; str.split() has four separators more.
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
SEPARATORS = re.compile("[\x1c-\x1f]")
#: What keeps a text from being lowered and cut before its marks as a whole: letters that may change form,
#: separators and a special token's start, and a mark that follows another one and so belongs to its word.
ODD = re.compile("[\u0130\u0250-\U0010ffff\x1c-\x1f\x85\xa0<_]")
JOINED = re.compile("[" + re.escape("".join(c for c in map(chr, range(0x250)) if unicodedata.category(c)[0] not in "LN" and not c.isspace())) + "][.,]")
WIDE = re.compile("[\u0250-\U0010ffff]")
#: Marks of one word when they stand together.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
MAGIC = b"LEX1"
NONE = np.uint32(0xFFFFFFFF)
HASH = np.uint32(2654435769)
#: Which bytes are white space, and masks that keep the first bytes of a 64-bit word.
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
KEEP = np.asarray([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _byte_symbols() -> list[str]:
    """The printable symbol that byte-level vocabularies use for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Vocabulary:
    """What a tokenizer file with word ends says: ids, merge ranks, special tokens and the word pattern."""

    def __init__(self, path: str) -> None:
        self.path, self.rules, self.hashed = path, None, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids, end = model["vocab"], model["end_of_word_suffix"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max(*ids.values(), *self.specials.values()) + 1
        if size > 1 << 16:
            raise ValueError("ids are kept in 16 bits")
        self.tokens = [""] * size
        for token, i in [*ids.items(), *self.specials.items()]:
            self.tokens[i] = token
        symbols = _byte_symbols()
        self.inner = [ids[s] for s in symbols]
        self.last = [ids[s + end] for s in symbols]
        # by the pair's first id: second id -> rank << 16 | id of the merged token
        self.pairs: list[dict[int, int]] = [{} for _ in range(size)]
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.pairs[ids[a]][ids[b]] = rank << 16 | ids[a + b]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None

    def newer(self, piece: str) -> list[str]:
        """Words of a piece with characters that Python's tables lack; the library's tables are of another year."""
        if self.rules is None:
            self.rules = Tokenizer.from_file(self.path)
            self.bytes = {s: b for b, s in enumerate(_byte_symbols())}
        found = self.rules.pre_tokenizer.pre_tokenize_str(self.rules.normalizer.normalize_str(piece))
        return [bytes(map(self.bytes.__getitem__, w)).decode() for w, _ in found]

    def merge(self, word: str) -> list[int]:
        """Ids of one word by merging, lowest rank first and leftmost among equals."""
        raw = word.encode()
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        if len(ids) > LONG:
            return self._merge_long(ids)
        pairs, none = self.pairs, 1 << 60
        ranks = [pairs[x].get(y, none) for x, y in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            ids[i] = new = best & 0xFFFF
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = pairs[ids[i - 1]].get(new, none)
            if i < len(ranks):
                ranks[i] = pairs[new].get(ids[i + 1], none)
        return ids

    def _table(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of ids in an open-addressed table, for lookups of many pairs at once."""
        if self.hashed is None:
            keys = np.asarray([a << 16 | b for a, row in enumerate(self.pairs) for b in row], np.uint32)
            values = np.asarray([v for row in self.pairs for v in row.values()], np.uint32)
            slots, held = np.zeros(1 << 18, np.uint32), np.full(1 << 18, NONE, np.uint32)
            at, left = (keys * HASH) >> np.uint32(14), np.arange(len(keys))
            while len(left):
                free = held[at[left]] == NONE
                _, first = np.unique(at[left[free]], return_index=True)
                put = left[free][first]
                slots[at[put]], held[at[put]] = keys[put], values[put]
                left = np.setdiff1d(left, put)
                at[left] = (at[left] + 1) & np.uint32((1 << 18) - 1)
            self.hashed = slots, held
        return self.hashed

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """rank << 16 | merged id of each pair, or NONE."""
        slots, held = self._table()
        key = a.astype(np.uint32) << np.uint32(16) | b.astype(np.uint32)
        at = (key * HASH) >> np.uint32(14)
        out = held[at]
        again = np.flatnonzero((slots[at] != key) & (out != NONE))
        out[again] = NONE
        while len(again):
            at[again] = (at[again] + 1) & np.uint32((1 << 18) - 1)
            found, k = held[at[again]], slots[at[again]] == key[again]
            out[again[k]] = found[k]
            again = again[~k & (found != NONE)]
        return out

    def merge_all(self, words: list[str]) -> list[bytes]:
        """merge() of many words at once, as 16-bit ids."""
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        out: list[bytes] = [b""] * len(raw)
        low = 1
        for width in (1, 4, 8, 12, 16, 24, LONG):
            some = np.flatnonzero((sizes >= low) & (sizes <= width))
            low = width + 1
            if len(some):
                for at in range(0, len(some), 1 << 15):
                    part = some[at : at + (1 << 15)]
                    for i, ids in zip(part.tolist(), self._merge_rows([raw[i] for i in part], sizes[part], width), strict=True):
                        out[i] = ids
        for i in np.flatnonzero(sizes > LONG).tolist():
            out[i] = np.asarray(self.merge(words[i]), "<u2").tobytes()
        return out

    def _merge_rows(self, raw: list[bytes], sizes: np.ndarray, width: int) -> list[bytes]:
        """Words of up to ``width`` bytes, one per row; each round merges every row's best pair."""
        byte = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raw), np.uint8).reshape(-1, width)
        ids = np.zeros((len(raw), width + 1), np.uint16)
        ids[:, :width] = np.asarray(self.inner, np.uint16)[byte]
        n, every = sizes.copy(), np.arange(len(raw))
        ids[every, n - 1] = np.asarray(self.last, np.uint16)[byte[every, n - 1]]
        ranks = np.full((len(raw), width + 1), NONE, np.uint32)
        for j in range(width - 1):
            some = np.flatnonzero(n > j + 1)
            ranks[some, j] = self._ranks(ids[some, j], ids[some, j + 1])
        done, cols = ids.copy(), np.arange(width)
        while len(every):
            at = ranks.argmin(1)
            here = np.arange(len(every))
            best = ranks[here, at]
            stop = best == NONE
            if stop.any():
                done[every[stop]] = ids[stop]
                go = ~stop
                every, ids, ranks, at, best = every[go], ids[go], ranks[go], at[go], best[go]
                here = np.arange(len(every))
            if not len(every):
                break
            ids[here, at] = (best & np.uint32(0xFFFF)).astype(np.uint16)
            after = cols >= at[:, None]
            ids[:, :width] = np.where(cols > at[:, None], ids[:, 1:], ids[:, :width])
            ranks[:, :width] = np.where(after, ranks[:, 1:], ranks[:, :width])
            n[every] -= 1
            has = np.flatnonzero(at > 0)
            ranks[has, at[has] - 1] = self._ranks(ids[has, at[has] - 1], ids[has, at[has]])
            has = np.flatnonzero(at < n[every] - 1)
            ranks[has, at[has]] = self._ranks(ids[has, at[has]], ids[has, at[has] + 1])
        flat = done.tobytes()
        step = 2 * (width + 1)
        return [flat[i * step : i * step + 2 * k] for i, k in enumerate(n.tolist())]

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap of pairs over a linked list."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (found := self.pairs[ids[i]].get(ids[j])) is not None:
                heapq.heappush(heap, (found, i, ids[i], ids[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            found, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = found & 0xFFFF, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [x for x in ids if x >= 0]


def compile_lexicon(words: dict[str, list[int]]) -> bytes:
    """The minimal automaton of the words with their ids, as one flat file.

    Words are added in byte order; once a branch can't change any more, each of its
    states is replaced by an equal one seen before.
    """
    kept: dict[tuple, int] = {}
    states: list[tuple] = []  # (final, number of words from here, ((label, target), ...))

    def freeze(node: list) -> int:
        final, arcs = node
        key = (final, tuple(arcs))
        if key not in kept:
            kept[key] = len(states)
            states.append((final, final + sum(states[t][1] for _, t in arcs), key[1]))
        return kept[key]

    path: list[list] = [[False, []]]
    previous = b""
    order = sorted(words, key=str.encode)
    for word in map(str.encode, order):
        same = next((i for i, (a, b) in enumerate(zip(word, previous, strict=False)) if a != b), min(len(word), len(previous)))
        while len(path) > same + 1:
            node = path.pop()
            path[-1][1].append((previous[len(path) - 1], freeze(node)))
        path += [[False, []] for _ in word[same:]]
        path[-1][0] = True
        previous = word
    while len(path) > 1:
        node = path.pop()
        path[-1][1].append((previous[len(path) - 1], freeze(node)))
    root = freeze(path[0])
    first, labels, targets, skips = [0], bytearray(), [], []
    for final, _, arcs in states:
        passed = int(final)
        for label, target in arcs:
            labels.append(label)
            targets.append(target)
            skips.append(passed)
            passed += states[target][1]
        first.append(len(labels))
    ids = [words[w] for w in order]
    ends = np.cumsum([0, *map(len, ids)])
    labels += bytes(-len(labels) % 4)
    parts = [np.asarray(x, "<u4").tobytes() for x in (first, targets, skips, ends)]
    finals = bytes(int(s[0]) for s in states)
    finals += bytes(-len(finals) % 4)
    parts += [bytes(labels), finals, np.asarray([i for x in ids for i in x], "<u2").tobytes()]
    return MAGIC + np.asarray([root, *map(len, parts)], "<u4").tobytes() + b"".join(parts)


class Lexicon:
    """A compiled lexicon, memory-mapped."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        if self.map[:4] != MAGIC:
            raise ValueError(f"{path} is no lexicon")
        view = memoryview(self.map)
        self.root, *sizes = view[4:36].cast("I")
        at, parts = 36, []
        for size in sizes:
            parts.append((at, view[at : at + size]))
            at += size
        self.first, self.targets, self.skips, self.ends = (p.cast("I") for _, p in parts[:4])
        self.labels = parts[4][0]
        self.finals = parts[5][1]
        self.ids = parts[6][1]

    def find(self, word: str) -> bytes | None:
        """The word's ids in 16 bits each, or None if it isn't one of the lexicon's."""
        state, number, base, first = self.root, 0, self.labels, self.first
        seek = self.map.find
        for b in word.encode():
            i = seek(bytes((b,)), base + first[state], base + first[state + 1]) - base
            if i < 0:
                return None
            number += self.skips[i]
            state = self.targets[i]
        return bytes(self.ids[2 * self.ends[number] : 2 * self.ends[number + 1]]) if self.finals[state] else None


class Encoder(dict):
    """Pieces between white space -> their ids in 16 bits each; remembers a bounded number."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None, most: int = KNOWN, together: int = TOGETHER) -> None:
        self.vocabulary, self.lexicon, self.most, self.together = vocabulary, lexicon, most, together
        self.known: dict[str, bytes] = {}
        self.seen: dict[bytes, bytes] = {}

    def normal(self, piece: str) -> str:
        if piece.isascii():
            return piece.lower()
        # letters are lowered one by one: a final sigma has no form of its own here
        piece = unicodedata.normalize("NFC", piece)
        return piece.lower() if "Σ" not in piece else "".join("σ" if c == "Σ" else c.lower() for c in piece)

    def words(self, piece: str) -> list[str]:
        """The words of a piece without special tokens."""
        if not piece.isascii() and max(piece) > "ɏ" and any(unicodedata.category(c) == "Cn" for c in piece):
            return self.vocabulary.newer(piece)
        piece = self.normal(piece)
        return [piece] if piece.isalpha() else self.vocabulary.words.findall(piece)

    def word(self, word: str) -> bytes:
        found = self.known.get(word)
        if found is None:
            found = self.lexicon.find(word) if self.lexicon else None
            if found is None:
                found = np.asarray(self.vocabulary.merge(word), "<u2").tobytes() if len(word) > LONG else b"".join(map(_PACKED.__getitem__, self.vocabulary.merge(word)))
            if len(word) <= LONG:
                if len(self.known) >= self.most:
                    self.known.clear()
                self.known[word] = found
        return found

    def __missing__(self, piece: str) -> bytes:
        v = self.vocabulary
        # below the first combining mark a text is its own normal form
        low = piece.lower() if piece.isascii() or max(piece) <= "ɏ" else ""
        if low.isalpha():
            found = self.known.get(low) or self.word(low)
        elif low and low[-1] in ".,!?;:" and low[:-1].isalpha():
            found = (self.known.get(low[:-1]) or self.word(low[:-1])) + self.word(low[-1])
        elif v.special and "<" in piece and v.special.search(piece):
            out, at = [], 0
            for m in v.special.finditer(piece):
                out += map(self.word, self.words(piece[at : m.start()]))
                out.append(_PACKED[v.specials[m[0]]])
                at = m.end()
            found = b"".join([*out, *map(self.word, self.words(piece[at:]))])
        else:
            found = b"".join(map(self.word, self.words(piece)))
        if len(piece) <= LONG:
            if len(self) >= self.most:
                self.clear()
            self[piece] = found
        return found

    def _ids_of(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece; those that are one word, or one and marks, are merged all at once."""
        joined = "\n".join(pieces)
        lows = joined.lower().split("\n") if pieces else []
        wide = WIDE.search(joined) is not None
        known, new = self.known, {}
        found: list[tuple[str, str] | None] = []
        put = found.append
        for low in lows:
            if low.isalpha():
                word, mark = low, ""
            else:
                word = low.rstrip(MARKS)
                mark = low[len(word) :]
                if not word.isalpha() or len(mark) > LONG:
                    put(None)
                    continue
            if wide and max(word) > "ɏ":
                put(None)
                continue
            put((word, mark))
            if word not in known:
                new[word] = None
        if len(known) + len(new) > self.most:
            known.clear()
            new = {x[0]: None for x in found if x}
        words = list(new)
        if self.lexicon:
            held = {w: x for w in words if (x := self.lexicon.find(w)) is not None}
            known.update(held)
            words = [w for w in words if w not in held]
        known.update(zip(words, self.vocabulary.merge_all(words), strict=True))
        marks = {m: self.word(m) if m else b"" for m in {x[1] for x in found if x}}
        return [self[p] if x is None else known[x[0]] + marks[x[1]] for p, x in zip(pieces, found, strict=True)]

    def _plain(self, texts: list[str]) -> list[bytes]:
        """All ids of texts that can be lowered and cut as a whole.

        Pieces of up to 32 bytes are compared as four 64-bit words, so equal ones are found
        by sorting numbers; each different piece is looked up once.
        """
        parts = [t.lower().replace(",", " ,").replace(".", " .").encode() for t in texts]
        blob = b" " + b" ".join(parts) + b" " * 48
        begins = np.cumsum([1, *(len(p) + 1 for p in parts)])
        data = np.frombuffer(blob, np.uint8)
        space = BLANK[data]
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        starts, ends = edges[::2], edges[1::2]
        if not len(starts):
            return [b""] * len(texts)
        size = ends - starts
        wide = np.ndarray((len(blob) - 7,), "<u8", blob, strides=(1,))
        words = [np.where(size > 8 * k, wide[starts + 8 * k] & KEEP[np.clip(size - 8 * k, 0, 8)], np.uint64(0)) for k in range(4)]
        mixed = words[0] * np.uint64(0x9E3779B97F4A7C15)
        for k, w in enumerate(words[1:]):
            mixed = (mixed ^ (mixed >> np.uint64(29)) ^ w) * np.uint64(0xBF58476D1CE4E5B9 + 2 * k)
        mixed ^= mixed >> np.uint64(32)
        order = np.argsort(mixed)
        fresh = np.concatenate(([True], mixed[order[1:]] != mixed[order[:-1]]))
        kind = np.empty(len(order), np.int64)
        kind[order] = np.cumsum(fresh) - 1
        first = order[fresh]
        # a piece that isn't its kind's first one, or is longer than what was compared, is a kind of its own
        alone = np.flatnonzero((size > 32) | np.any([w != w[first][kind] for w in words], axis=0))
        kind[alone] = len(first) + np.arange(len(alone))
        first = np.concatenate((first, alone))
        pieces = [blob[a:z] for a, z in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        ids = list(map(self.seen.get, pieces))
        lacking = [i for i, x in enumerate(ids) if x is None]
        if lacking:
            got = self._ids_of(b"\n".join(pieces[i] for i in lacking).decode().split("\n"))
            if len(self.seen) + len(got) > self.most:
                self.seen.clear()
            for i, x in zip(lacking, got, strict=True):
                ids[i] = x
            self.seen.update((pieces[i], x) for i, x in zip(lacking, got, strict=True) if len(pieces[i]) <= LONG)
        flat = np.frombuffer(b"".join(ids), "<u2")
        each = np.fromiter(map(len, ids), np.int64, len(ids)) >> 1
        at = np.concatenate(([0], np.cumsum(each)[:-1]))
        counts = each[kind]
        upto = np.concatenate(([0], np.cumsum(counts)))
        out = flat[np.repeat(at[kind] - upto[:-1], counts) + np.arange(upto[-1])].tobytes()
        cut = (2 * upto[np.searchsorted(starts, begins)]).tolist()
        return [out[a:z] for a, z in zip(cut, cut[1:], strict=False)]

    def pieces(self, text: str) -> list[str]:
        """A text cut at white space."""
        return text.split() if not SEPARATORS.search(text) else [p for p in SPACE.split(text) if p]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """All ids of each text as little-endian 16-bit numbers."""
        out: list[bytes] = [b""] * len(texts)
        plain: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            if not text:
                continue
            if ODD.search(text) or JOINED.search(text):
                out[i] = b"".join(map(self.__getitem__, self.pieces(text)))
            else:
                plain.append(i)
                size += len(text)
            if size >= self.together:
                for k, x in zip(plain, self._plain([texts[k] for k in plain]), strict=True):
                    out[k] = x
                plain.clear()
                size = 0
        for k, x in zip(plain, self._plain([texts[k] for k in plain]) if plain else [], strict=True):
            out[k] = x
        return out

    def encode(self, text: str | None) -> bytes:
        """All ids of one text."""
        return self.encode_all([text])[0]


_PACKED = [i.to_bytes(2, "little") for i in range(1 << 16)]
_DECIMAL = [str(i) for i in range(1 << 16)]
_ENCODERS: dict[tuple[str, str | None], Encoder] = {}


def encoder(path: str, lexicon: str | None = None) -> Encoder:
    """The worker's encoder for a vocabulary and a lexicon file that Spark has delivered."""
    key = (path, lexicon)
    if key not in _ENCODERS:
        vocabulary = next((e.vocabulary for (p, _), e in _ENCODERS.items() if p == path), None) or Vocabulary(path)
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(vocabulary, Lexicon(SparkFiles.get(lexicon)), KNOWN_LESS, TOGETHER_LESS) if lexicon else Encoder(vocabulary)
    return _ENCODERS[key]


def decode(ids: Iterable[int], tokens: list[str]) -> str:
    """The vocabulary has no decoder, so its tokens stand with single spaces between."""
    return " ".join(map(tokens.__getitem__, ids))


def _reduce(counts: Counter, size: int) -> Counter:
    """The Misra-Gries summary of counts with at most ``size`` counters."""
    if len(counts) <= size:
        return counts
    values = np.fromiter(counts.values(), np.int64, len(counts))
    off = int(np.partition(values, len(values) - size - 1)[len(values) - size - 1])
    return Counter({w: c - off for w, c in counts.items() if c > off})


def word_counts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(word, n): summed summaries of the words of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, pieces = encoder(path), Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                pieces.update((t or "").lower().split())
                if len(pieces) > 2 * COUNTERS:
                    pieces = _reduce(pieces, COUNTERS)
        counts: Counter = Counter()
        for piece, n in pieces.items():
            for w in e.words(piece) if len(piece) <= LONG else ():
                counts[w] += n
        rows = iter(_reduce(counts, COUNTERS).items())
        while part := list(islice(rows, 1 << 14)):
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part]), pa.array([n for _, n in part])], ["word", "n"])

    return arrow_map(docs.select(column(text)), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def deliver_lexicon(docs: DataFrame, path: str, text: str = "text", size: int = LEXICON) -> str:
    """Compile the lexicon of the ``size`` most counted words and send it to every executor; its file name."""
    counts = cut(word_counts(docs, path, text), "words")
    # counts by powers of two, 64 rows at most, tell from which count on there are enough words; few others are sorted
    left, least = size, 0
    for r in counts.groupBy(F.floor(F.log2("n")).alias("power")).agg(F.count("*").alias("words")).orderBy(F.desc("power")).collect():
        left -= r.words
        if left <= 0:
            least = 1 << r.power
            break
    top = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(size).collect()
    v = Vocabulary(path)
    data = compile_lexicon({r.word: v.merge(r.word) for r in top if r.word})
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    folder = tempfile.mkdtemp(prefix="lexicon-")
    with open(os.path.join(folder, name), "wb") as f:
        f.write(data)
    docs.sparkSession.sparkContext.addFile(os.path.join(folder, name))
    return name


def encode_decode(docs: DataFrame, path: str, text: str = "text", more: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 and decoded_sha256 appended, and the ids and decoded text if ``more`` names them.

    The new columns replace those of the same names.
    """
    kinds = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"} | {c: {"ids": "array<int>", "decoded": "string"}[c] for c in more}
    added = list(kinds)
    kept = [c for c in docs.columns if c not in added]
    lexicon = deliver_lexicon(docs, path, text)
    rows = docs.select(*map(column, kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, lexicon)
        tokens = e.vocabulary.tokens
        for b in batches:
            raws = e.encode_all(b.column(text).to_pylist())
            digests: list[tuple[str, str]] = []
            texts: list[str] = []
            for raw in raws:
                ids = np.frombuffer(raw, "<u2").tolist()
                decoded = decode(ids, tokens)
                digests.append((hashlib.sha256(" ".join(map(_DECIMAL.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
                if "decoded" in more:
                    texts.append(decoded)
            sizes = np.fromiter((len(r) // 2 for r in raws), np.int64, len(raws))
            new = [pa.array(sizes), pa.array([x for x, _ in digests], pa.string()), pa.array([y for _, y in digests], pa.string())]
            for c in more:
                if c == "ids":
                    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                    new.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raws), "<u2").astype(np.int32))))
                else:
                    new.append(pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *new], [*kept, *added])

    return arrow_map(rows, run, appended(rows.schema, kinds))
