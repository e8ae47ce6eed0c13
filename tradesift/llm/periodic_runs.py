"""Periodic runs of words by Crochemore's partition refinement.

Places of a text are parted into classes of equal factors, by length 1, 2, 3 and so on. From one length to the next a
class is parted by the classes of the places that follow; of a parted class all parts but the largest are kept, and only
these part others in the next step, so a place takes part in at most log(n) steps. Where two neighbours of a class of
length L are L apart, a square of period L starts; no shorter period can explain it, for then a nearer place would stand
between them. Squares that start one after another make up a run.

The first lengths are refined for many texts at once in arrays, since there nearly all places are still in question; a
place whose factor stands alone in its text is out for good. Texts that still have classes after them are refined one by
one by smaller halves.

A run is a stretch of words with smallest period q, as long as ``LEAST`` words and ``POWERS`` periods at least, that no
neighbouring word extends. ``collapse`` keeps the first period of each run.

The contract's rewriting of every tenth document into a periodic one is a step of its own, ``planted``.

Defined cases: null text has no words; a null doc_id is not rewritten; texts without runs have an empty list; repeated
rows give equal rows; texts go through whole, several at a time; an empty table gives an empty result. Only doc_id and
text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradesift.llm.bpe import pieces
from tradesift.llm.common import text_of

LEAST, POWERS = 24, 3
#: Lengths that are refined in arrays, for many texts at once.
TOGETHER = 6
#: Of start, length, period.
Run = tuple[int, int, int]


def merged(starts: list[int], period: int, least: int, powers: int) -> list[Run]:
    """Runs of squares of one period that start at ``starts``, in order."""
    out = []
    first = last = None
    for i in [*starts, None]:
        if last is not None and i != last + 1:
            length = last - first + 2 * period
            if length >= max(least, powers * period):
                out.append((first, length, period))
            first = i
        elif last is None:
            first = i
        last = i
    return out


def refine_together(words: np.ndarray, text: np.ndarray, levels: int) -> tuple[list[tuple[int, np.ndarray]], np.ndarray, np.ndarray]:
    """Squares of periods up to ``levels`` in many texts, as (period, starts); and the places whose factors of that length
    stand more than once in their text, with their classes, both ordered by class and place.

    ``words``, ``text``: of every place the word and the text, as numbers; texts one after another."""
    n = len(words)
    label = np.full(n + 1, -1, np.int64)
    key, places = text.astype(np.int64) * (int(words.max(initial=0)) + 1) + words, np.arange(n)
    squares = []
    for length in range(1, levels + 1):
        order = np.argsort(key, kind="stable")
        key, places = key[order], places[order]
        new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
        number = np.cumsum(new) - 1
        several = np.bincount(number, minlength=1)[number] > 1 if len(number) else np.zeros(0, bool)
        places, number = places[several], number[several]
        label[:] = -1
        label[places] = number
        near = (number[1:] == number[:-1]) & (places[1:] - places[:-1] == length)
        squares.append((length, np.sort(places[:-1][near])))
        if length < levels:
            following = label[places + 1]
            # A factor that reaches into the next text, or is followed by one that stands alone, stands alone.
            going = (following >= 0) & (places + length < n)
            going[going] = text[places[going] + length] == text[places[going]]
            key = number[going] * (int(number.max(initial=0)) + 1) + following[going]
            places = places[going]
            order = np.argsort(places, kind="stable")
            key, places = key[order], places[order]
    return squares, places, label[places]


def refine_by_halves(places: list[int], classes: list[int], n: int, level: int, least: int = LEAST, powers: int = POWERS) -> list[Run]:
    """Runs of periods above ``level`` in a text of ``n`` words. ``places``: of factors of length ``level`` that stand more
    than once, ordered by class and place."""
    of, after, before = {}, {}, {}
    members: dict[int, list[int]] = {}
    for i, c in zip(places, classes):
        members.setdefault(c, []).append(i)
    gaps: dict[int, list[int]] = {}  # places by the distance to the next of their class, as it was when they were linked
    size, head = {}, {}
    for c, own in members.items():
        size[c], head[c] = len(own), own[0]
        for i, j in zip(own, own[1:]):
            after[i], before[j] = j, i
            gaps.setdefault(j - i, []).append(i)
        for i in own:
            of[i] = c
    fresh = max(members, default=0) + 1
    # At first every class parts those before it, the ones of one place included.
    parting = [*members.values(), *([i + 1] for i in places if i + 1 not in of)]
    found: list[Run] = []
    while size:
        parts: dict[int, list[list[int]]] = {}
        for cause in parting:
            taken: dict[int, list[int]] = {}
            for j in cause:
                c = of.get(j - 1)
                if c is not None:
                    taken.setdefault(c, []).append(j - 1)
            for c, own in taken.items():
                parts.setdefault(c, []).append(own)
        level += 1
        parting = []
        for c, split in parts.items():
            moved = sum(map(len, split))
            rest = size[c] - moved
            if rest == 0 and len(split) == 1:
                continue  # the class stays as it is
            if rest:
                for own in split:
                    for i in own:  # out of the class's list
                        p, q = before.pop(i, None), after.pop(i, None)
                        if p is None:
                            head[c] = q
                        else:
                            after[p] = q
                            if q is None:
                                del after[p]
                            else:
                                gaps.setdefault(q - p, []).append(p)
                        if q is not None:
                            if p is None:
                                before.pop(q, None)
                            else:
                                before[q] = p
                size[c] = rest
            else:
                del size[c], head[c]
                for own in split:
                    for i in own:
                        before.pop(i, None)
                        after.pop(i, None)
            largest = max(rest, max(map(len, split)))
            spared = rest == largest
            if rest and not spared:
                own, i = [], head[c]
                while i is not None:
                    own.append(i)
                    i = after.get(i)
                parting.append(own)
            for own in split:
                if not spared and len(own) == largest:
                    spared = True
                else:
                    parting.append(own)
                if len(own) == 1:
                    of.pop(own[0])
                    continue
                size[fresh], head[fresh] = len(own), own[0]
                for i, j in zip(own, own[1:]):
                    after[i], before[j] = j, i
                    gaps.setdefault(j - i, []).append(i)
                for i in own:
                    of[i] = fresh
                fresh += 1
            if rest == 1:
                i = head.pop(c)
                del size[c]
                of.pop(i)
        if level in gaps:
            starts = sorted({i for i in gaps.pop(level) if after.get(i) == i + level})
            found += merged(starts, level, least, powers)
    return found


def runs_of(words: np.ndarray, counts: np.ndarray, least: int = LEAST, powers: int = POWERS) -> list[list[Run]]:
    """The runs of each text, by start, then period. ``words``: of all texts, as numbers; ``counts``: of each text."""
    ends = np.cumsum(counts)
    text = np.repeat(np.arange(len(counts)), counts)
    squares, places, classes = refine_together(words, text, TOGETHER)
    out: list[list[Run]] = [[] for _ in counts]
    starts = ends - counts
    for period, at in squares:
        if len(at):
            # Squares of one run start one after another, and never in two texts.
            cut = np.flatnonzero(np.diff(at) != 1) + 1
            first, last = at[np.concatenate(([0], cut))], at[np.concatenate((cut - 1, [len(at) - 1]))]
            length = last - first + 2 * period
            long = length >= max(least, powers * period)
            for a, m in zip(first[long].tolist(), length[long].tolist()):
                out[text[a]].append((a - int(starts[text[a]]), m, period))
    if len(places):
        of = text[places]
        order = np.argsort(of, kind="stable")
        places, classes, of = places[order], classes[order], of[order]
        for own in np.split(np.arange(len(of)), np.flatnonzero(np.diff(of)) + 1):
            t = int(of[own[0]])
            out[t] += refine_by_halves((places[own] - starts[t]).tolist(), classes[own].tolist(), int(counts[t]), TOGETHER, least, powers)
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def dropped(runs: list[Run], n: int) -> np.ndarray:
    """Of each word, whether some run has it after that run's first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) > 0


def strongest(runs: list[Run]) -> Run | None:
    """The run of greatest length / period; of ties the first, then that of the shortest period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def planted(words: np.ndarray, doc_id) -> np.ndarray:
    """The contract's rewriting: of every tenth id the words from some place on repeat with a period."""
    n = len(words)
    if doc_id is None or n == 0:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return words[at]


FIELDS = [("doc_id", None), ("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("best", pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])), ("collapsed", pa.binary())]


def find_runs(docs: DataFrame, rewrite: Callable[[np.ndarray, object], np.ndarray] | None = None, least: int = LEAST, powers: int = POWERS) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period by start, then period), best (the strongest, or null), collapsed
    (the words that stay, joined by one space, in UTF-8): one row per row of ``docs``. ``rewrite`` rearranges a text's words
    before."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, texts in pieces(batch.column(1), raw=True):
                ids = batch.column(0).slice(a, len(texts))
                split = [t.split() for t in texts]  # of bytes: at \x20 and \x09-\x0D only
                index = {w: i for i, w in enumerate(set().union(*split))}
                numbers = [np.fromiter(map(index.__getitem__, w), np.int64, len(w)) for w in split]
                if rewrite:
                    numbers = [rewrite(w, i) for w, i in zip(numbers, ids.to_pylist())]
                vocabulary = list(index)
                counts = np.fromiter(map(len, numbers), np.int64, len(numbers))
                found = runs_of(np.concatenate(numbers), counts, least, powers)
                kept = [b" ".join([vocabulary[w] for w in (own[~dropped(r, len(own))] if r else own).tolist()]) for own, r in zip(numbers, found)]
                named = [[dict(zip(("start", "length", "period"), x)) for x in r] for r in found]
                best = [dict(zip(("start", "length", "period"), x)) if (x := strongest(r)) else None for r in found]
                yield pa.RecordBatch.from_arrays([ids, pa.array(counts), pa.array(named, FIELDS[2][1]), pa.array(best, FIELDS[3][1]), pa.array(kept, pa.binary())], [f for f, _ in FIELDS])

    one = "struct<start:long,length:long,period:long>"
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, runs array<{one}>, best {one}, collapsed binary")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 of what ``find_runs`` returns."""
    line: Callable[[Column], Column] = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
