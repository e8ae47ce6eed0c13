"""Periodic runs against brute force; importance resampling against strings and plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tradesift.llm import importance, periodic_runs, queries

SCHEMA = "doc_id long, text string, score string, runs string, rank string, n string"


def brute_runs(w, least=24, powers=3):
    n, out = len(w), []
    for q in range(1, n // powers + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            stretch = w[i : i + length]
            if length >= max(least, powers * q) and not any(stretch[d:] == stretch[:-d] for d in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if n and doc_id is not None and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def awkward():
    rnd = random.Random(7)
    rows = [(None, "a " * 40), (1, None), (2, ""), (3, " \t\n "), (4, "x"), (5, "same words here"), (5, "same words here"), (6, "é b c\x0bd " * 30), (7, "a b " * 9000), (8, "a " * 23), (9, "a " * 24)]
    for i in range(10, 140):
        w = [rnd.choice("abc") for _ in range(rnd.randint(1, 90))]
        rows.append((i, " ".join(w + w[: rnd.randint(0, 9)] * rnd.randint(0, 12))))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z", "n") for i, t in rows], SCHEMA)


def test_runs_query(spark):
    rows = awkward()
    got = periodic_runs.digest(periodic_runs.find_runs(frame(spark, rows), periodic_runs.planted)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((brute_row(*r) for r in rows), key=repr)
    assert sum(r.n_runs for r in got) > 50
    assert periodic_runs.find_runs(frame(spark, [])).collect() == []


def test_runs_over_the_table(spark, data):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = queries.QUERIES["op11_periodic_runs"](spark, data).collect()
    short = [i for i, t in docs.items() if len((t or "").split()) < 700]
    assert len(got) == len(docs) and len(short) > 100
    assert [tuple(r) for r in sorted(got) if r.doc_id in set(short)] == [brute_row(i, docs[i]) for i in sorted(short)]


def test_runs_of_any_threshold():
    rnd = random.Random(3)
    for _ in range(1500):
        docs = []
        for _ in range(rnd.randint(1, 4)):
            w = [rnd.randrange(rnd.choice((1, 2, 3, 9))) for _ in range(rnd.choice((0, 1, 5, 40, 90)))]
            if w and rnd.random() < 0.6:
                s, p = rnd.randrange(len(w)), rnd.randint(1, max(1, len(w) // 3))
                w = [w[i if i < s else s + (i - s) % p] for i in range(len(w))]
            docs.append(w)
        limits = rnd.choice(((24, 3), (4, 2), (6, 3)))
        got = periodic_runs.runs_of(np.array(sum(docs, []), np.int64), np.array([len(d) for d in docs]), *limits)
        assert got == [brute_runs(d, *limits) for d in docs]


def test_long_periods_take_linear_steps():
    """A text of 60,000 words that is one run of period 20,000, and one of a single word."""
    words = np.concatenate((np.arange(60_000) % 20_000, np.zeros(60_000, np.int64)))
    assert periodic_runs.runs_of(words, np.array([60_000, 60_000])) == [[(0, 60_000, 20_000)], [(0, 60_000, 1)]]


def test_composed_crcs():
    rnd = random.Random(2)
    texts = [" ".join("".join(rnd.choice("aé9日z") for _ in range(rnd.choice((1, 2, 7, 300)))) for _ in range(rnd.randint(0, 30))).encode() for _ in range(60)]
    for k, (crc, counts) in enumerate(importance.Features(4)(texts), 1):
        want = [zlib.crc32(b" ".join(t.split()[i : i + k])) for t in texts for i in range(len(t.split()) - k + 1)]
        assert crc.tolist() == want
        assert counts.tolist() == [max(0, len(t.split()) - k + 1) for t in texts]


def brute_importance(rows, target, longest, buckets):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    marks = lambda t: [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for w in [words(t)] for k in range(1, longest + 1) for i in range(len(w) - k + 1)]
    s, t = (Counter(b for x in texts for b in marks(x)) for texts in ([t for _, t in rows], target))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in s}
    out = []
    for i, text in rows:
        m = marks(text)
        weight = sum(gain[b] for b in m) // len(m) if m else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words(text)), len(m), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(able[: len(able) * 10 // 100])}
    return [(*r, rank.get(id(r))) for r in out]


@pytest.mark.parametrize(("longest", "buckets"), [(1, 10_000), (3, 97)])
def test_importance(spark, longest, buckets):
    rnd = random.Random(5)
    rows = [(None, "a b " * 30), (0, None), (1, ""), (2, "!?"), (3, "É日本 B2b-c"), (4, "w " * 20), (5, "w " * 19)]
    rows += [(i, " ".join(rnd.choice(("Alpha", "beta", "x1", "gamma's", "é")) for _ in range(rnd.randint(0, 60)))) for i in range(6, 300)]
    target = ["alpha beta", "alpha, x1", None]
    given = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = importance.importance(frame(spark, rows), given, longest, buckets).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute_importance(rows, target, longest, buckets), key=repr)
    assert importance.importance(frame(spark, []), given, longest, buckets).collect() == []
    nothing = given.filter("false")
    assert len(importance.importance(frame(spark, rows), nothing, longest, buckets).collect()) == len(rows)


def test_ties_and_repeated_rows(spark):
    rows = [(7, "a b c " * 10)] * 30 + [(8, "a b c " * 10)] * 30
    got = importance.importance(frame(spark, rows), frame(spark, rows[:1])).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4, 5, 6]
    assert len({r.doc_id for r in got if r["rank"]}) == 1
