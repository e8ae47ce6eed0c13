"""Quality rules, dedup, mixing and the pipeline against brute force, on small tables with awkward rows."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tradesift.llm import exact_dedup, quality_rules, simhash_dedup, source_mixing

WORDS = re.compile("[^\x20\x09-\x0d]+")
LONG = " ".join(f"w{i % 977} the of" for i in range(20_000))
TEXTS = [None, "", " \t\n", "A b", "a B", "the cat sat on the mat and it was not the end of all", LONG, LONG + " x", "é́ 👩 ÀB àb", "x\ny\nx\n\n  \nx", "# # | < > $ 1 2 3 4 5 6", "one two three four five " * 6, "a" * 50_000]
SCHEMA = "doc_id long, text string, source string, kept string, size long, _row string, key long"


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, ties, repeated rows, very long texts, and columns whose names clash with the operators' own."""
    rows = [(i, t, ["a", None, "b", ""][i % 4], "k", i, "r", 7) for i, t in enumerate(TEXTS)]
    rows += [(100, "A b", "a", None, None, None, None)] * 2 + [(None, "lost row", None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return WORDS.findall(t or "")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute_quality(t):
    w, t = words(t), t or ""
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(docs, empty):
    got = quality_rules.quality(docs).join(docs.select("doc_id", "text").distinct(), "doc_id").collect()
    for r in got:
        n, *rest = brute_quality(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *rest), r.doc_id
        assert r.base_failed == (n < 10 or 100 * rest[3] > 20 * n)
        assert r.kept == (not r.base_failed and not r.failed_rules)
    verdict = {r.doc_id: r.kept for r in got}
    assert verdict[5] and not verdict[10] and not verdict[11]
    assert quality_rules.quality(docs).count() == docs.count()
    assert quality_rules.quality(empty).count() == 0
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, v in verdict.items() if v}


@pytest.mark.parametrize("bucket_keys", [1, 3, 1000])
def test_exact_groups(docs, empty, bucket_keys):
    rows = [(r.doc_id, lower(r.text)) for r in docs.collect()]
    top = {}
    for i, t in rows:
        top[t] = max((x for x in (top.get(t), i) if x is not None), default=None)
    size = Counter(t for _, t in rows)
    want = sorted(((i, top[t], size[t], i == top[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in rows), key=repr)
    assert sorted(map(tuple, exact_dedup.exact_groups(docs, bucket_keys).collect()), key=repr) == want
    assert exact_dedup.exact_groups(empty).count() == 0


def test_directory_splits_until_buckets_fit(spark):
    keys = spark.range(2000).select(F.xxhash64("id").alias("key"))
    slots = {r.slot: r for r in exact_dedup.directory(keys, bucket_keys=100).collect()}
    held = Counter(slots[(r.key & (2**64 - 1)) >> (64 - exact_dedup.DEPTH)].bucket for r in keys.collect())
    assert max(held.values()) <= 100 and len(held) >= 20
    tight = exact_dedup.directory(spark.createDataFrame([(5,), (6,)], "key long"), bucket_keys=1).collect()
    assert [r.local_depth for r in tight] == [exact_dedup.DEPTH]


def test_drop_copies_keeps_one_row_of_each(docs, empty):
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    texts = [lower(r.text) for r in kept.collect()]
    assert sorted(texts) == sorted({lower(r.text) for r in docs.collect()})
    assert 100 in {r.doc_id for r in kept.collect()} and exact_dedup.drop_copies(empty).count() == 0


def fingerprint(t):
    w = words(lower(t))
    g = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints):
    """Least id over links of at most three bits, by union of all pairs."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_near_groups(docs, empty):
    given = [(r.doc_id, fingerprint(r.text)) for r in docs.collect()]
    comp = components([f for _, f in given])
    least = {c: min((i for (i, _), x in zip(given, comp) if x == c and i is not None), default=None) for c in comp}
    want = sorted(((i, f"{f:016x}", least[c]) for (i, f), c in zip(given, comp)), key=repr)
    assert sorted(map(tuple, simhash_dedup.near_groups(docs).collect()), key=repr) == want
    assert simhash_dedup.near_groups(empty).count() == 0
    kept = simhash_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(comp))


@pytest.mark.parametrize("hot", [3, 10_000])
def test_links_find_every_component(spark, hot):
    """Chains and clouds of near fingerprints, through hot and ordinary anchors."""
    rng = np.random.default_rng(5)
    prints = {0, 2**64 - 1}
    for _ in range(8):
        f = int(rng.integers(0, 2**63)) * 2 + int(rng.integers(0, 2))
        for _ in range(int(rng.integers(1, 25))):
            prints.add(f)
            for b in rng.choice(64, int(rng.integers(1, 5)), replace=False).tolist():
                f ^= 1 << b
    prints = sorted(prints)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    edges = simhash_dedup.links(spark.createDataFrame([(p,) for p in signed], "fp long"), hot)
    got = {r.node: r.root for r in simhash_dedup.components(edges).collect()}
    comp = components(prints)
    label = {}
    for s, c in zip(signed, comp):
        label.setdefault(c, []).append(s)
    assert all(got.get(s, s) == min(group) for group in label.values() for s in group)


def test_anchors_cover():
    x = np.random.default_rng(1).integers(0, 2**31, 2000, dtype=np.uint32)
    rows, anchor, home = simhash_dedup.anchors(x)
    far = np.bitwise_count(x[rows] ^ anchor)
    assert (simhash_dedup.syndrome(anchor) == 0).all() and (far[home] <= 1).all() and (far <= 2).all() and home.sum() == len(x)


def test_mix(spark, docs, empty):
    rows = [(i, "w " * (1 + i * 7 % 23), f"s{i % 7}" if i % 7 else None) for i in range(700)] + [(900, "big " * 900, "s1"), (901, None, "zero")]
    got = source_mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), slice_rows=16).collect()
    size = Counter()
    for _, t, s in rows:
        size[s] += len(words(t))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(size.values()), {}
    while True:
        rest, w = total - sum(capped.values()), sum(weight[s] for s in names if s not in capped)
        over = {s: 2 * size[s] for s in names if s not in capped and weight[s] * rest / w > 2 * size[s]}
        if not over:
            break
        capped |= over
    taken = Counter()
    for r in got:
        assert r.source_size == size[r.source] and r.taken == r.copies * r.size <= 2 * r.size
        assert math.isclose(r.target, capped.get(r.source, weight[r.source] * rest / w), abs_tol=1e-9)
        taken[r.source] += r.taken
    longest = Counter()
    for r in got:
        longest[r.source] = max(longest[r.source], r.size)
    for r in got:  # the bound of the docstring: the longest document, and an eighth of sizes inside the classes
        assert abs(taken[r.source] - r.target) <= longest[r.source] + 0.02 * r.target, r.source
    # One prefix sum for each source, rebuilt from the order alone.
    key = lambda r, n: int(hashlib.md5(f"{source_mixing.SEED}:{r}".encode()).hexdigest()[:n], 16)
    for s in names:
        own = sorted((r for r in got if r.source == s), key=lambda r: ((r.size.bit_length() * 8 + (r.size * 8 >> r.size.bit_length() - 1)) if r.size else 0, key("" if r.doc_id is None else r.doc_id, 15)))
        rate, u = own[0].target / size[s] if size[s] else 0, key(f"{int(s is None)}:{s or ''}", 13) / 2**52
        assert [r.copies for r in own] == [math.floor(k * rate + u) - math.floor((k - 1) * rate + u) for k in range(1, len(own) + 1)]
    again = source_mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5), slice_rows=16).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert source_mixing.mix(empty).count() == 0 and source_mixing.mix(docs).count() == docs.count()


def test_repeat_documents(docs, empty):
    out = source_mixing.repeat_documents(docs)
    assert out.columns == docs.columns and out.count() == source_mixing.mix(docs).agg(F.sum("copies")).first()[0]
    assert source_mixing.repeat_documents(empty).count() == 0


def test_repeat_documents_keeps_texts_that_tie(spark):
    """Null and repeated ids with texts of one length, of one source: no text takes the copies of another."""
    rows = [(None if i % 2 else 5, f"text number {i}", "s", i // 4) for i in range(40)] + [(5, "text number 0", "s", 77), (5, "text number 0", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang long")
    # At twice its size a single source takes each row exactly twice.
    out = source_mixing.repeat_documents(docs, share=(2, 1)).collect()
    assert Counter(map(tuple, out)) == Counter(rows * 2)


def test_expected_copies_over_all_offsets(spark):
    """Over seeds every document is taken target/size times on average."""
    df = spark.createDataFrame([(i, "w " * (1 if i else 500), f"s{i % 2}") for i in range(12)], "doc_id long, text string, source string")
    total = Counter()
    for seed in range(8):
        for r in source_mixing.mix(df, seed=seed).collect():
            total[r.doc_id] += r.copies
            rate = r.target / r.source_size
            assert r.copies in (math.floor(rate), math.ceil(rate))
    rates = {r.doc_id: r.target / r.source_size for r in source_mixing.mix(df).collect()}
    assert all(abs(total[i] / 8 - rates[i]) < 0.6 for i in rates)


def test_pipeline_of_awkward_rows(spark, docs, empty, tmp_path):
    """Null, empty, very long and repeated texts, null and repeated ids, columns of the operators' own names; an empty table."""
    prose = "the cat sat on the mat and it was not the end of all that a reader of {} would like to see in a book of {}"
    good = spark.createDataFrame([(None, prose.format("one", "trees"), "a", "k", 1, "r", 7), (3, prose.format("ships", "iron"), None, None, None, None, None)] * 2, SCHEMA)
    docs.unionByName(good).write.parquet(f"{tmp_path}/some/documents.parquet")
    empty.write.parquet(f"{tmp_path}/none/documents.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/some").collect()
    assert out and all(r.round_trip for r in out) and {r.doc_id for r in out} <= {None, 3, 5} and max(Counter(r.doc_id for r in out).values()) <= 4
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_pipeline_equals_its_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    kept = [i for i in sorted(rows) if quality_ok(spark, rows)[i]]
    last = {}
    for i in kept:
        last[lower(rows[i].text)] = i
    kept = sorted(last.values())
    prints = [fingerprint(rows[i].text) for i in kept]
    comp = components(prints)
    least = {}
    for i, c in zip(kept, comp):
        least.setdefault(c, i)
    step = docs
    for (name, stage), want in zip(corpus_pipeline.STAGES[:3], (None, set(last.values()), set(least.values()))):
        step = stage(spark, step, data)
        assert step.columns == columns
        if want is not None:
            assert {r.doc_id for r in step.select("doc_id").collect()} == want, name
    out = corpus_pipeline.run(spark, data).collect()
    assert {r.doc_id for r in out} <= set(least.values()) and all(r.round_trip for r in out)
    assert Counter(r.doc_id for r in out) == Counter({r.doc_id: r.copies for r in source_mixing.mix(docs.filter(F.col("doc_id").isin(list(least.values())))).collect() if r.copies})


_cache: dict = {}


def quality_ok(spark, rows):
    if not _cache:
        df = spark.createDataFrame(list(rows.values()))
        _cache.update({r.doc_id: r.kept for r in quality_rules.quality(df).collect()})
    return _cache


def weak(norm):
    """A hash of four values: nearly all keys collide."""
    return F.shiftleft(F.xxhash64(norm).bitwiseAND(3), 62)


@pytest.mark.parametrize("bucket_keys", [1, 1000])
def test_chains_compare_bytes(docs, bucket_keys):
    strong = sorted(map(repr, exact_dedup.exact_groups(docs).collect()))
    assert sorted(map(repr, exact_dedup.exact_groups(docs, bucket_keys, hash_of=weak).collect())) == strong
    found = exact_dedup.build(docs, bucket_keys, hash_of=weak)
    for r in found.index.groupBy("bucket", "key").agg(F.sort_array(F.collect_list("chain")).alias("c"), F.first("links").alias("n")).collect():
        assert r.c == list(range(1, r.n + 1))
    want = sorted({lower(r.text) for r in docs.collect()})
    assert sorted(lower(r.text) for r in exact_dedup.drop_copies(docs, bucket_keys, hash_of=weak).collect()) == want


def test_hot_text_and_many_buckets(spark):
    """A third of all rows is one text; 5,000 texts split the directory; ids repeat and are null."""
    rows = [(i % 9000 if i % 7 else None, f"Text {i % 3 and i}") for i in range(9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    top, size = {}, Counter(t.lower() for _, t in rows)
    for i, t in rows:
        top[t.lower()] = max((x for x in (top.get(t.lower()), i) if x is not None), default=None)
    got = exact_dedup.exact_groups(df, bucket_keys=300)
    assert Counter(map(tuple, got.select("doc_id", "keep_id", "group_size", "text_sha256").collect())) == Counter((i, top[t.lower()], size[t.lower()], hashlib.sha256(t.lower().encode()).hexdigest()) for i, t in rows)
    assert exact_dedup.build(df, bucket_keys=300).index.select("bucket").distinct().count() > 8
    assert exact_dedup.drop_copies(df, bucket_keys=300).count() == len(size)
