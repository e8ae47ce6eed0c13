"""Repeated passages against brute force over every string."""

import hashlib
import random

import numpy as np
import pytest

from tradesift.llm import queries, repeat_removal as R

SCHEMA = "doc_id long, text string, block string, row string, spans string, kept string"


def brute(rows, width):
    """Digest rows; of rows that share a doc_id the ones given first count as earlier."""
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - width + 1):
            if raw[k : k + width] in seen:
                gone[k : k + width] = True
            seen.add(raw[k : k + width])
        spans = int((np.diff(np.concatenate(([False], gone)).astype(int)) == 1).sum())
        out.append((i, len(raw), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z", "k") for i, t in rows], SCHEMA)


def got(spark, rows, **settings):
    return sorted(map(tuple, R.digest(R.remove_repeats(frame(spark, rows), **settings)).collect()), key=repr)


def corpus(seed, letters, n):
    """Texts that share passages, copies with edits among them, and rare and frequent passages."""
    rnd = random.Random(seed)
    make = lambda k: "".join(rnd.choice(letters) for _ in range(k))
    passages = [make(rnd.choice((20, 45, 60, 130, 260))) for _ in range(6)]
    texts = []
    for _ in range(n):
        if texts and rnd.random() < 0.3:
            t = list(rnd.choice(texts))
            for _ in range(rnd.randint(0, 2)):
                if t:
                    t[rnd.randrange(len(t))] = rnd.choice(letters)
            texts.append("".join(t))
        else:
            texts.append("".join(rnd.choice((make(rnd.randint(0, 50)), rnd.choice(passages))) for _ in range(rnd.randint(0, 7))))
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("seed", "letters", "hot"), [(1, "abcdefgh é日", 5000), (2, "ab", 5000), (3, "abcdefgh é日", 2), (4, "ab", 0)])
def test_every_string(spark, monkeypatch, seed, letters, hot):
    """With segments gathered by anchor, and with anchors counted as too frequent for that."""
    monkeypatch.setattr(R, "HOT", hot)
    rows = corpus(seed, letters, 150)
    want = brute(rows, 40)
    assert got(spark, rows, width=40, gram=12) == want
    assert sum(r[2] for r in want) > 1000


def test_awkward_rows(spark):
    long = "word " * 30_000
    rows = [(None, "n" * 150), (3, None), (4, ""), (5, "x" * 99), (6, "x" * 100), (7, "x" * 101), (1, "é" * 50), (2, "日" * 33 + "a"), (8, "same text " * 12), (8, "same text " * 12), (9, long), (10, long[7:]), (11, "n" * 120)]
    assert got(spark, rows) == brute(rows, 100)
    assert got(spark, []) == []
    found = {r.doc_id: r for r in R.remove_repeats(frame(spark, rows)).collect()}
    assert [tuple(s) for s in found[10].spans] == [(0, len(long) - 7)] and found[10].kept == b""
    assert found[6].spans == [] and found[6].kept == b"x" * 100


def test_many_blocks(spark, monkeypatch):
    """Blocks of a few rows, owners of a few anchors, small pieces of text at a time."""
    monkeypatch.setattr(R, "CHUNK", 300)
    rows = corpus(5, "abc ", 200)
    df = frame(spark, rows).repartition(7)
    assert sorted(map(tuple, R.digest(R.remove_repeats(df, 40, 12)).collect()), key=repr) == brute(rows, 40)


def test_suffix_sort():
    rnd = np.random.default_rng(3)
    for _ in range(60):
        data = rnd.integers(0, rnd.choice([1, 2, 5]), rnd.integers(1, 120)).astype(np.uint8)
        at = rnd.integers(0, len(data), rnd.integers(0, 90))
        size = np.minimum(rnd.integers(0, 60, len(at)), len(data) - at)
        group = np.sort(rnd.integers(0, 4, len(at)))
        order, common = R.sorted_suffixes(data, at, size, group)
        raw = [data[a : a + n].tobytes() for a, n in zip(at, size)]
        assert [(g, raw[i]) for g, i in zip(group, order)] == sorted(zip(group, raw))
        for k in range(1, len(at)):
            a, b = raw[order[k - 1]], raw[order[k]]
            same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert common[k] == (same if group[k] == group[k - 1] else 0)


def test_collisions_are_found(monkeypatch):
    """A base of one makes hashes of any order of the same bytes equal; the next base is taken."""
    data = np.frombuffer(b"abba" + b"baab", np.uint8)
    monkeypatch.setattr(R, "BASES", (1, 1, 1, R.BASES[2]))
    order, common = R.sorted_suffixes(data, np.array([0, 4]), np.array([4, 4]), np.array([0, 0]))
    assert order.tolist() == [0, 1] and common.tolist() == [0, 0]
    monkeypatch.setattr(R, "BASES", (1, 1, 1))
    with pytest.raises(RuntimeError):
        R.sorted_suffixes(data, np.array([0, 4]), np.array([4, 4]), np.array([0, 0]))


def test_the_whole_table(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.QUERIES["op13_repeat_removal"](spark, data).collect()), key=repr) == brute(rows, 100)
