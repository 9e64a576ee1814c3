"""Toxicity by the nearest labelled examples under TF-IDF cosine.

Terms of a text are its words and the beginnings (PREFIXES letters) that at least two
different words of it share. Examples are a bounded sample of the labelled rows, drawn by a
hash of their ids, at most EXAMPLES of each label. All terms that LEAST_SHARE of the
examples hold span the vector space, whatever the examples' labels; so their number is at
most a text's usual number of terms by LEAST_SHARE, and grows with neither corpus nor
examples. Document frequencies are counted over all texts. A term that stands n times
weighs (1 + ln n) * ln(N / df) ** RARITY.

The index holds the examples in blocks of BLOCK and for each term the largest weight in
each block. A text's bound for a block is its weights times those maxima. Many texts are
taken together: blocks are scored in turn for the texts whose bound still exceeds the
worst of their nearest found, a text's own best block first, so the neighbours are the
exact ones; a text has as many as the square root of the number of examples. In a block,
terms that many examples hold are dense rows, others are postings. Examples are put in
order of their likeness first, so that a block's bounds are tight for texts of another
kind. A text that is an example itself is not its own neighbour.

The neighbours' labels vote with the cosine against a weight FAR for a clean label far
away, so that only distant neighbours count for little, and a logistic curve, fitted to the
votes that examples get from the others with each label weighed by its share of all
labelled rows, turns votes into scores. Texts without a term have no neighbour and get the
share of toxic rows among such examples.

Defined results: null and empty texts have no term; repeated rows are scored each;
labels of ids without a text are ignored; an id labelled twice counts as toxic if one
label says so; without labels of both kinds every score is the share of toxic ones (0
without any label); ties of neighbours go to the example that comes first; extra columns
are kept, and the two new ones take the names they are given.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.arrow import appended, arrow_map, column, release
from mnemospark.plans.lineage import cut

#: Labelled rows drawn of label 0 and of label 1.
EXAMPLES = (12_000, 3_000)
#: Terms of fewer examples are left out.
LEAST_SHARE, LEAST_TEXTS = 0.002, 2
RARITY = 1.5
PREFIXES = (4, 5, 6, 7, 8)
FAR = 0.5
BLOCK = 512
#: Groups of like examples that blocks are filled from.
KINDS = 8
#: Examples are likened by the terms that a larger share of all holds; terms that a larger share
#: of a block holds are its dense rows, at most ROWS of them, the others postings.
FREQUENT, DENSE, ROWS = 1 / 16, 1 / 16, 800
#: Texts whose neighbours are searched together.
TOGETHER = 1024
#: Texts scored at a time against a block, so that what is between stays in the processor's cache.
PIECE = 256
#: Partial counts that a task holds before it passes them on.
HELD = 300_000
#: Words counted at a time; words that a worker remembers, and the length of those that bear on no term.
WORDS, REMEMBERED, LONGEST = 1 << 18, 100_000, 40
WORD = re.compile(r"\w+")
#: What stands beside words and is no white space.
BESIDE = re.compile(r"[^\w\s]+")


def shared_beginnings(words: Iterable[str]) -> dict[str, int]:
    """Beginnings that several different words share, with the number of words beyond the first."""
    out: dict[str, int] = {}
    left = list(words)
    for k in PREFIXES:
        # words that share a longer beginning share this one
        left = [w for w in left if len(w) > k]
        begun = Counter([w[:k] for w in left])
        if len(begun) == len(left):
            break
        shared = {p: n - 1 for p, n in begun.items() if n > 1}
        out |= shared
        left = [w for w in left if w[:k] in shared]
    return out


def terms(text: str | None) -> set[str]:
    """Words, and with a caret the beginnings that several of them share."""
    words = Counter(WORD.findall(text.lower())) if text else Counter()
    return {*words, *("^" + p for p in shared_beginnings(words))}


class Known:
    """Numbers of words that bear on known terms, 0 for all others; kept by word, since texts repeat most of theirs."""

    def __init__(self, names: list[str]) -> None:
        self.words = {f: i for i, f in enumerate(names) if f[0] != "^"}
        self.begun = {f[1:]: i for i, f in enumerate(names) if f[0] == "^"}
        self.heads = {p[: PREFIXES[0]] for p in self.begun}
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        # by number: the word's term or -1, and the end of its beginnings' terms; 0 stands for all other words
        self.term, self.ends, self.begins = array("q", [-1]), array("q", [0]), array("q")
        self.missed = 0

    def trim(self) -> None:
        """Called once numbers are used up: forget them if there are many, or if many words had none."""
        if len(self.term) > 2 * REMEMBERED or self.missed > 8 * REMEMBERED:
            self.forget()

    def word(self, word: str) -> int:
        """The number of a word that may have none yet."""
        number = self.number.get(word)
        if number is not None:
            return number
        self.missed += 1
        number, own, begins = 0, self.words.get(word, -1), ()
        if word[: PREFIXES[0]] in self.heads:
            begins = [self.begun[word[:k]] for k in PREFIXES if len(word) > k and word[:k] in self.begun]
        if own >= 0 or begins:
            number = len(self.term)
            self.term.append(own)
            self.begins.extend(begins)
            self.ends.append(len(self.begins))
        if number or (len(self.number) < REMEMBERED and len(word) <= LONGEST):
            self.number[word] = number
        return number

    def numbers(self, text: str) -> np.ndarray:
        words = BESIDE.sub(" ", text.lower()).split()
        found = list(map(self.number.get, words))
        if None in found:
            for k, number in enumerate(found):
                if number is None:
                    found[k] = self.word(words[k])
        return np.fromiter(found, np.int64, len(found))


class Space:
    """Counts of known terms of texts."""

    def __init__(self, names: list[str]) -> None:
        self.size, self.known = len(names), Known(names)

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(terms, counts) of a text."""
        return self.counts_of([text])[0]

    def counts_of(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(terms, counts) of each text, terms in order."""
        out: list[tuple[np.ndarray, np.ndarray]] = []
        held: list[np.ndarray] = []
        count = 0
        for text in texts:
            held.append(self.known.numbers(text or ""))
            count += len(held[-1])
            if count >= WORDS:
                out += self._counted(held)
                held, count = [], 0
        return out + self._counted(held)

    def _counted(self, held: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(terms, counts) by text of texts' words, given by number."""
        of = np.repeat(np.arange(len(held)), [len(w) for w in held])
        number = np.concatenate([np.empty(0, np.int64), *held])
        key, n = np.unique((of << 32 | number)[number > 0], return_counts=True)
        of, number = key >> 32, key & 0xFFFFFFFF
        term, ends, begins = (np.array(x, np.int64) for x in (self.known.term, self.known.ends, self.known.begins))
        first = ends[number - 1]
        sizes = ends[number] - first
        # the words of a text that share a beginning, each once
        shared, several = np.unique(np.repeat(of, sizes) << 32 | begins[_ranges(first, sizes)], return_counts=True)
        shared, several = shared[several > 1], several[several > 1] - 1
        own = term[number]
        key = np.concatenate(((of << 32 | own)[own >= 0], shared))
        n = np.concatenate((n[own >= 0], several))
        order = np.argsort(key)
        key, n = key[order], n[order].astype(np.int32)
        edges = np.searchsorted(key >> 32, np.arange(1, len(held)))
        self.known.trim()
        return list(zip(np.split((key & 0xFFFFFFFF).astype(np.int32), edges), np.split(n, edges), strict=True)) if held else []


def select(examples: DataFrame, total: int) -> list[str]:
    """The terms that LEAST_SHARE of the ``total`` examples (text) hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: Counter = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(df), pa.string()), pa.array(list(df.values()), pa.int64())], ["f", "n"])
            df.clear()
            return out

        for batch in batches:
            for t in batch.column(0).to_pylist():
                df.update(terms(t))
                if len(df) > HELD:
                    yield rows()
        yield rows()

    summed = arrow_map(examples.select("text"), run, "f string, n long").groupBy("f").agg(F.sum("n").alias("n"))
    least = max(LEAST_TEXTS, math.ceil(LEAST_SHARE * total))
    return sorted(r.f for r in summed.where(F.col("n") >= least).select("f").collect())


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def kinds(term: np.ndarray, weight: np.ndarray, of: np.ndarray, n: int, row: np.ndarray, size: int) -> np.ndarray:
    """An order of examples in which like ones stand together: by the nearest of KINDS centres over frequent terms."""
    x = np.zeros((n, size), np.float32)
    some = row[term] >= 0
    x[of[some], row[term[some]]] = weight[some]
    x /= np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))
    # centres begin far apart: each next one is the example least like those before
    centres, like = [], np.full(n, -1.0)
    for _ in range(min(KINDS, n)):
        centres.append(x[int(like.argmin())])
        like = np.maximum(like, x @ centres[-1])
    if not centres:
        return np.arange(n)
    c = np.stack(centres)
    for _ in range(5):
        kind = (x @ c.T).argmax(1)
        c = np.stack([x[kind == k].sum(0) for k in range(len(c))])
        c /= np.maximum(1e-9, np.linalg.norm(c, axis=1, keepdims=True))
    near = x @ c.T
    return np.lexsort((np.arange(n), -near.max(1).round(4), near.argmax(1)))


class Index:
    """Block-max inverted index of vectors, each given as (terms, weights)."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], size: int) -> None:
        sizes = np.fromiter((len(t) for t, _ in vectors), np.int64, len(vectors))
        self.build(sizes, *(np.concatenate([np.empty(0, kind), *(v[k] for v in vectors)]).astype(kind) for k, kind in ((0, np.int32), (1, np.float64))), size)

    @classmethod
    def of(cls, sizes: np.ndarray, term: np.ndarray, weight: np.ndarray, size: int) -> Index:
        """The index of vectors that stand one after the other."""
        out = cls.__new__(cls)
        out.build(sizes, term, weight, size)
        return out

    def build(self, sizes: np.ndarray, term: np.ndarray, weight: np.ndarray, size: int) -> None:
        """Block by block, so that little more than the index itself is held."""
        self.n, self.size = n, _ = len(sizes), size
        df = np.bincount(term, minlength=size)
        frequent = np.flatnonzero(df > FREQUENT * max(1, n))
        row = np.full(size, -1, np.int64)
        row[frequent] = np.arange(len(frequent))
        self.order = kinds(term, weight, np.repeat(np.arange(n, dtype=np.int32), sizes), n, row, len(frequent))  # place -> example
        self.place = np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)
        self.blocks = -(-n // BLOCK)
        first = np.cumsum(sizes) - sizes

        def entries(b: int) -> tuple[np.ndarray, np.ndarray]:
            """Where a block's entries are, and of which of its examples."""
            held = self.order[b * BLOCK : (b + 1) * BLOCK]
            return _ranges(first[held], sizes[held]), np.repeat(np.arange(len(held), dtype=np.int16), sizes[held])

        self.highest = np.zeros((size, self.blocks), np.float32)
        common = []
        for b in range(self.blocks):
            held = np.bincount(term[entries(b)[0]], minlength=size)
            most = np.argsort(-held, kind="stable")[:ROWS]
            common.append(most[held[most] > DENSE * BLOCK])
        #: The row of a term in a block, or the last one, which is empty.
        self.rows = max(map(len, common), default=0)
        self.row = np.full((self.blocks, size), self.rows, np.int16)
        self.dense = np.zeros((self.blocks, self.rows, BLOCK))
        self.starts = np.zeros(self.blocks * size + 1, np.int32)
        ids, weights = [np.empty(0, np.int16)], [np.empty(0)]
        for b, most in enumerate(common):
            self.row[b, most] = np.arange(len(most))
            at, of = entries(b)
            t, w = term[at], weight[at]
            np.maximum.at(self.highest[:, b], t, np.nextafter(w.astype(np.float32), np.float32(2)))
            r = self.row[b, t]
            is_dense = r < self.rows
            self.dense[b, r[is_dense], of[is_dense]] = w[is_dense]
            t, w, of = t[~is_dense], w[~is_dense], of[~is_dense]
            by_term = np.argsort(t, kind="stable")
            ids.append(of[by_term])
            weights.append(w[by_term])
            self.starts[b * size + 1 : (b + 1) * size + 1] = self.starts[b * size] + np.cumsum(np.bincount(t, minlength=size))
        self.ids, self.weights = np.concatenate(ids), np.concatenate(weights)

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(cosines, examples) of each query's k nearest, by cosine and then example; 0 and -1 where fewer are above 0."""
        m = len(queries)
        best, which = np.zeros((m, k)), np.full((m, k), -1, np.int64)
        sizes = np.fromiter((len(t) for t, _ in queries), np.int64, m)
        if not self.n or not sizes.sum():
            return best, which
        term, weight = np.concatenate([t for t, _ in queries]).astype(np.int64), np.concatenate([w for _, w in queries])
        bounds = np.zeros((m, self.blocks))
        filled = np.flatnonzero(sizes)
        starts = np.concatenate(([0], np.cumsum(sizes)))
        for at in range(0, len(filled), PIECE):
            part = filled[at : at + PIECE]
            held = slice(starts[part[0]], starts[part[-1] + 1])
            bounds[part] = np.add.reduceat(self.highest[term[held]] * weight[held, None], starts[part] - starts[part[0]], axis=0)
        skip = np.asarray([self.place[x] if x >= 0 else -1 for x in without], np.int64) if without is not None else np.full(m, -1)
        first = bounds.argmax(1)
        hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        # every text's best block sets its threshold; then each block is scored for the texts that it may still matter to
        for own, b in [(True, b) for b in np.unique(first[filled]).tolist()] + [(False, b) for b in np.argsort(-bounds.mean(0), kind="stable").tolist()]:
            all_rows = np.flatnonzero((bounds[:, b] >= np.maximum(best[:, 0] - 1e-9, 1e-300)) & ((first == b) == own))
            for at in range(0, len(all_rows), PIECE):
                rows = all_rows[at : at + PIECE]
                mine = starts[rows + 1] - starts[rows]
                held, of = _ranges(starts[rows], mine), np.repeat(np.arange(len(rows)), mine)
                t, w = term[held], weight[held]
                row = self.row[b, t]
                dense = np.zeros((len(rows), self.rows + 1))
                dense[of, row] = w  # the last row takes what has no row
                scores = dense[:, :-1] @ self.dense[b]
                t += b * self.size
                low = self.starts[t]
                count = self.starts[t + 1] - low
                # one posting after the other: its place in the index and the number of its query's term
                of_term = np.repeat(np.arange(len(t)), count)
                ends = np.cumsum(count)
                places = (low - (ends - count))[of_term] + np.arange(len(of_term))
                cells = (of * BLOCK)[of_term] + self.ids[places]
                scores += np.bincount(cells, w[of_term] * self.weights[places], scores.size).reshape(scores.shape)
                hit = np.flatnonzero((skip[rows] >= 0) & (skip[rows] // BLOCK == b))
                scores[hit, skip[rows][hit] % BLOCK] = 0
                # examples of equal vectors must tie whatever the order of their sums
                scores = scores.round(10)
                # the k best cosines so far; what reaches the least of them is kept, with ties
                s = np.concatenate((best[rows], scores), 1)
                s.partition(s.shape[1] - k, axis=1)
                best[rows] = s[:, -k:]
                r, c = np.nonzero(scores >= np.maximum(s[:, -k], 1e-300)[:, None])
                hits.append((rows[r], scores[r, c], self.order[b * BLOCK + c]))
        r, s, i = (np.concatenate(x) for x in zip(*hits, strict=True)) if hits else (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))
        reach = s >= best[r, 0]
        r, s, i = r[reach], s[reach], i[reach]
        order = np.lexsort((i, -s, r))
        r, s, i = r[order], s[order], i[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        best[:], r, s, i, rank = 0, r[rank < k], s[rank < k], i[rank < k], rank[rank < k]
        best[r, rank], which[r, rank] = s, i
        return best, which


#: The index of the model that this process used last, by the model's name.
_INDEX: dict[str, Index] = {}


class Model:
    """What the executors need to score texts; each builds the index itself from the examples' terms and counts."""

    def __init__(self, names: list[str], idf: np.ndarray, examples: list[tuple[int, int, np.ndarray, np.ndarray]], sizes: tuple[int, int], shares: tuple[float, float]) -> None:
        """``examples``: (id, label, terms, counts) of those that have a term; sizes: of all examples by label."""
        self.name, self.names, self.idf = uuid.uuid4().hex, names, idf
        self.ids, self.labels = [i for i, *_ in examples], np.asarray([y for _, y, *_ in examples], np.int64)
        held = [np.concatenate([np.empty(0, np.int32), *x]).astype(np.int32) for x in zip(*(e[2:] for e in examples), strict=True)] or [np.empty(0, np.int32)] * 2
        lengths = np.fromiter((len(t) for _, _, t, _ in examples), np.int32, len(examples))
        self.packed = zlib.compress(b"".join(x.tobytes() for x in (lengths, *held)), 1)
        self.neighbours = math.ceil(math.sqrt(max(1, sum(sizes))))
        self.weight = np.asarray([shares[k] / max(1, sizes[k]) for k in (0, 1)])
        bare = [self.weight[k] * (sizes[k] - int((self.labels == k).sum())) for k in (0, 1)]
        self.bare = bare[1] / sum(bare) if sum(bare) > 0 else shares[1]
        self.curve = (0.0, 0.0)

    def fit(self, votes: dict[int, float]) -> None:
        """Fit the curve to the votes that examples get from the others, by id."""
        own = [k for k, i in enumerate(self.ids) if i in votes]
        if own:
            labels = self.labels[own]
            self.curve = logistic(np.asarray([votes[self.ids[k]] for k in own]), labels, self.weight[labels])

    def prepare(self) -> None:
        """Build what scoring needs, once in a process."""
        if self.name not in _INDEX:
            raw = np.frombuffer(zlib.decompress(self.packed), np.int32)
            sizes, rest = raw[: len(self.ids)].astype(np.int64), raw[len(self.ids) :]
            term, of = rest[: len(rest) // 2], np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
            weight = (1 + np.log(rest[len(rest) // 2 :])) * self.idf[term]
            some = weight > 0
            term, of, weight = term[some], of[some], weight[some]
            del raw, rest
            weight /= np.sqrt(np.bincount(of, weight * weight, len(sizes)))[of]
            sizes = np.bincount(of, minlength=len(sizes))
            del of
            _INDEX.clear()
            _INDEX[self.name] = Index.of(sizes, term, weight, len(self.names))
            release()
        if not hasattr(self, "space"):
            self.space, self.example = Space(self.names), {i: k for k, i in enumerate(self.ids)}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("space", "example")}

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(counts)) * self.idf[terms]
        some = w > 0
        terms, w = terms[some], w[some]
        return terms, w / math.sqrt((w * w).sum()) if len(w) else w

    def votes(self, cosines: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Share of toxic neighbours by cosine; not a number without a neighbour."""
        toxic = np.where(which >= 0, self.labels[which] if len(self.labels) else 0, 0)
        total = cosines.sum(1)
        return np.where(total > 0, (cosines * toxic).sum(1) / (total + FAR), np.nan)

    def neighbours_of(self, texts: list[str | None], ids: list[int | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Cosines and examples nearest to each text, a text's own example left out, some texts at a time."""
        self.prepare()
        for at in range(0, len(texts), TOGETHER):
            vectors = [self.vector(*x) for x in self.space.counts_of(texts[at : at + TOGETHER])]
            yield _INDEX[self.name].nearest(vectors, self.neighbours, [self.example.get(i, -1) for i in ids[at : at + TOGETHER]])

    def votes_of(self, texts: list[str | None], ids: list[int | None]) -> np.ndarray:
        return np.concatenate([np.empty(0), *(self.votes(*x) for x in self.neighbours_of(texts, ids))])

    def score_all(self, texts: list[str | None], ids: list[int | None]) -> tuple[np.ndarray, list[str]]:
        """Scores, and as evidence the three nearest examples as id:label:cosine."""
        out, evidence = [np.empty(0)], []
        a, b = self.curve
        for cosines, which in self.neighbours_of(texts, ids):
            votes = self.votes(cosines, which)
            with np.errstate(invalid="ignore"):
                out.append(np.where(np.isnan(votes), self.bare, 1 / (1 + np.exp(-np.clip(a * votes + b, -30, 30)))))
            evidence += [",".join(f"{self.ids[i]}:{self.labels[i]}:{s:.3f}" for s, i in zip(c, w, strict=True) if i >= 0) for c, w in zip(cosines[:, :3].tolist(), which[:, :3].tolist(), strict=True)]
        return np.concatenate(out), evidence


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and intercept of a weighted logistic fit with a weak prior, by Newton's method."""
    w = weight / max(weight.sum(), 1e-12) * len(x)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * x + b)))
        g = np.asarray([(w * (y - p) * x).sum() - 0.01 * a, (w * (y - p)).sum() - 0.01 * b])
        h = w * p * (1 - p)
        m = np.asarray([[(h * x * x).sum() + 0.01, (h * x).sum()], [(h * x).sum(), h.sum() + 0.01]])
        step = np.linalg.solve(m, g)
        a, b = a + float(np.clip(step[0], -5, 5)), b + float(np.clip(step[1], -5, 5))
        if np.abs(step).max() < 1e-9:
            break
    return max(a, 0.0), b


def term_df(docs: DataFrame, names: list[str], text: str = "text") -> tuple[int, np.ndarray]:
    """The number of texts, and of those that hold each term; one row of sums per task and term."""
    size = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, space = np.zeros(size + 1, np.int64), Space(names)
        for b in batches:
            sums[-1] += b.num_rows
            for at, _ in space.counts_of(b.column(0).to_pylist()):
                sums[at] += 1
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["at", "n"])

    rows = arrow_map(docs.select(column(text)), run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()  # a row for each term and one more
    out = np.zeros(size + 1, np.int64)
    for r in rows:
        out[r["at"]] = r["n"]
    return int(out[-1]), out[:-1]


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", most: tuple[int, int] = EXAMPLES) -> Model:
    """Fit on the rows of ``labels`` (doc_id, toxic) that it is given."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    totals = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total = sum(totals.values())
    shares = tuple(totals.get(k, 0) / total if total else 1.0 - k for k in (0, 1))
    drawn = [(r.doc_id, r.toxic) for k in (0, 1) for r in known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most[k]).collect()]
    ids = docs.sparkSession.createDataFrame(drawn, "id long, toxic int")
    # at most sum(most) rows are broadcast
    examples = docs.select(column(doc_id).alias("id"), column(text).alias("text")).join(F.broadcast(ids), "id")
    examples = cut(examples.groupBy("id", "toxic").agg(F.max("text").alias("text")), "examples")
    sizes = {r.toxic: r.n for r in examples.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    sizes = (sizes.get(0, 0), sizes.get(1, 0))
    names = select(examples, sum(sizes))
    n, df = term_df(docs, names, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Space(names)
        for b in batches:
            rows = [(i, y, t.tobytes(), c.tobytes()) for i, y, (t, c) in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), space.counts_of(b.column(2).to_pylist()), strict=True) if len(t)]
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["id", "toxic", "at", "n"])

    rows = arrow_map(examples.select("id", "toxic", "text"), run, "id long, toxic int, at binary, n binary").collect()  # sum(most) rows at most
    vectors = [(r.id, r.toxic, np.frombuffer(r.at, np.int32), np.frombuffer(r.n, np.int32)) for r in sorted(rows, key=lambda r: r.id)]
    model = Model(names, np.log(np.maximum(1, n / np.maximum(df, 1))) ** RARITY, vectors, sizes, shares)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sent.value.votes_of(b.column(1).to_pylist(), b.column(0).to_pylist()))], ["id", "vote"])

    tasks = max(1, min(sum(sizes) // TOGETHER, docs.sparkSession.sparkContext.defaultParallelism))
    found = arrow_map(examples.select("id", "text").repartition(tasks), vote, "id long, vote double").where("not isnan(vote)").collect()  # sum(most) rows at most
    model.fit({r.id: r.vote for r in found})
    return model


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id", score: str = "__score", evidence: str = "__evidence") -> DataFrame:
    """``docs`` with the score and its evidence appended; no shuffle."""
    kept = [c for c in docs.columns if c not in (score, evidence)]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            found, why = m.score_all(b.column(text).to_pylist(), b.column(doc_id).to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(found), pa.array(why, pa.string())], [*kept, score, evidence])

    return arrow_map(docs.select(*map(column, kept)), run, appended(docs.select(*map(column, kept)).schema, {score: "double", evidence: "string"}))


def learnable(labels: DataFrame) -> DataFrame:
    """The labels whose ids are not held out."""
    return labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
