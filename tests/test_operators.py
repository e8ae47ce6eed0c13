"""Joins, folds, state and feeds against brute force and golden cases."""

import datetime as dt
import itertools
import json
import random
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tradesift import schemas
from tradesift.config import DEFAULT
from tradesift.operators import classify, cluster, dedup, reports, sales, setjoin, sizing, state
from tradesift.sources import feeds

T0 = dt.datetime(2026, 7, 1, 12)


def set_pairs(spark, sets, threshold):
    found = setjoin.similar_sets(spark.createDataFrame([(list(s),) for s in sets], "tokens array<string>"), threshold)
    named = {r.id: tuple(r.tokens) for r in found.sets.collect()}
    links = [(*sorted((named[r.a], named[r.b])), r.similarity) for r in found.links.collect()]
    assert {(tuple(r.tokens), r.links) for r in setjoin.link_counts(found).collect()} == {(s, sum(s in p[:2] for p in links)) for s in named.values()}
    return links


def all_pairs(sets, threshold):
    return {(a, b): len(set(a) & set(b)) / len(set(a) | set(b)) for a, b in itertools.combinations(sorted(s for s in sets if s), 2) if len(set(a) & set(b)) / len(set(a) | set(b)) > threshold}


@pytest.mark.parametrize(("threshold", "hot"), [(0.3, 1000), (0.6, 1000), (0.6, 2), (0.85, 4), (0.9, 1000)])
def test_similar_sets_equal_brute_force(spark, monkeypatch, threshold, hot):
    """Few letters, so every token is in many sets; with frequent ones split; sets of rare tokens of their own as well."""
    monkeypatch.setattr(setjoin, "HOT", hot)
    rnd = random.Random(1)
    sets = {tuple(sorted({rnd.choice("abcdefghijkl") for _ in range(rnd.randint(0, 12))} | {f"own{rnd.randrange(60)}" for _ in range(rnd.choice((0, 0, 1, 2)))})) for _ in range(220)}
    got = set_pairs(spark, [*sets, *list(sets)[:20]], threshold)
    want = all_pairs(sets, threshold)
    assert len(got) == len(want) and {p[:2]: p[2] for p in got} == want


def test_no_similar_sets(spark):
    assert set_pairs(spark, [], 0.5) == [] and set_pairs(spark, [("a",), ("b",), ("a", "b", "c"), ()], 0.5) == []


def greedy(items, t, enforce):
    kept, dropped = [], set()
    for seq, norm, toks, exempt in items:
        hit = not exempt and norm and any(n == norm or (toks and k and len(toks & k) / len(toks | k) > t) for n, k in kept)
        if hit:
            dropped.add(seq)
        if norm and (not hit or not enforce):
            kept.append((norm, toks))
    return dropped


def test_title_dedup_matches_the_sequential_rule(spark):
    rnd = random.Random(3)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    base = [rnd.sample(words, 8) for _ in range(6)]
    data = []
    for seq in range(60):
        w = list(rnd.choice(base))
        if rnd.random() < 0.7:
            w[rnd.randrange(8)] = rnd.choice(words + ["new"])
        data.append((seq, " ".join(w) if seq % 13 else "", rnd.choice(["press", "press", "NSE"])))
    df = spark.createDataFrame(data, "seq long, title string, source string")
    none = spark.createDataFrame([], "title_norm string")
    items = [(s, t, frozenset(t.split()) - {"a"}, src == "NSE") for s, t, src in data]
    shadow, enforced = None, None
    for enforce in (False, True):
        got = {r.seq for r in dedup.title_duplicates(df, none, replace(DEFAULT, enforce=enforce, dedup_jaccard=0.7)).filter("is_duplicate").collect()}
        assert got == greedy(items, 0.7, enforce)
        shadow, enforced = (got, enforced) if not enforce else (shadow, got)
    assert enforced <= shadow


@pytest.mark.parametrize("rounds", [0, 2, 24])
def test_dropped_in_order(spark, rounds):
    """Long chains, stars and random graphs, by rounds, by rounds and then a fold, by a fold alone."""
    rnd = random.Random(9)
    edges = {(i, i - 1) for i in range(1, 60)} | {(100 + i, 100) for i in range(1, 30)} | {(200 + i, 200 + rnd.randrange(i)) for i in range(1, 120) for _ in range(2)}
    gone: set = set()
    for i in sorted({i for e in edges for i in e}):
        if any(a == i and b not in gone for a, b in edges):
            gone.add(i)
    got = dedup.dropped_in_order(spark.createDataFrame(sorted(edges) * 2, "seq long, earlier long"), rounds).collect()
    assert sorted(r.seq for r in got) == sorted(gone)
    assert dedup.dropped_in_order(spark.createDataFrame([], "seq long, earlier long")).count() == 0


def test_copies_of_a_headline_add_no_rows(spark):
    df = spark.range(10_000).selectExpr("id AS seq", "'Acme promoter sells big stake today' AS title", "'press' AS source")
    none = spark.createDataFrame([], "title_norm string")
    assert dedup.title_matches(dedup.prepared(df), none)[1].count() == 1
    for enforce in (False, True):
        assert dedup.title_duplicates(df, none, replace(DEFAULT, enforce=enforce)).filter("is_duplicate").count() == 9_999


def report(seq, company, amount, hours, **more):
    row = {"seq": seq, "title": company, "url": "", "source": "x", "company": company, "amount_cr": amount, "amount_raw": None, "individuals": [], "seller": None, "deal_type": "other", "confidence": "medium", "one_line": "", "size_source": "stated", "size_band": None, "confirmed": False, "at": T0 + dt.timedelta(hours=hours)}
    return row | more


def test_clustering(spark):
    given = [
        report(1, "Fine Edge Engineering", None, 0),
        report(2, "Fine Edge (Ashok Iron Works)", 1000.0, 10),  # attaches by name, amount added
        report(3, "Fine Edge", 1200.0, 20),  # 20 %: silent
        report(4, "Fine Edge", 1441.0, 30, seller="S"),  # 44 % over the kept 1000: update
        report(5, "Fine Other", 1440.0, 100),  # amount path
        report(6, "Fine Edge", None, 200),  # out of both windows: new
        report(7, "M&M", 10.0, 0), report(8, "M&M", 10.0, 0),  # no tokens: never cluster
        report(9, "Fine Edge", 1500.0, 201, confirmed=True, individuals=["A"]),
    ]
    got = {r.seq: r for r in cluster.cluster(spark.createDataFrame([tuple(x[c] for c in cluster.REPORT_COLUMNS) for x in given], cluster.REPORT), schemas.empty(spark, "deals")).collect()}
    assert [got[i].deal_ref for i in range(1, 10)] == ["r1", "r1", "r1", "r1", "r1", "r6", "r7", "r8", "r6"]
    assert [got[i].fires for i in range(1, 10)] == [True, True, False, True, False, True, True, True, True]
    assert got[2].note == "amount added" and got[4].note == "amount revised 1000→1441 cr" and got[9].note == "amount confirmed"
    assert got[9].confirmed and list(got[9].individuals) == ["A"]


def as_frame(spark, given):
    return spark.createDataFrame([tuple(x[c] for c in cluster.REPORT_COLUMNS) for x in given], cluster.REPORT)


@pytest.mark.parametrize("seed", range(3))
def test_groups_hold_all_that_can_match(spark, monkeypatch, seed):
    """Random reports and open deals: folded in groups as in one go."""
    monkeypatch.setattr(cluster, "FEW", 0)
    rnd = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    amounts = [None, 100.0, 104.0, 130.0, 200.0, 209.0, 500.0, 0.0]
    given = [report(i, " ".join(rnd.sample(words, rnd.randint(1, 3))), rnd.choice(amounts), rnd.randint(0, 900), confirmed=rnd.random() < 0.2) for i in range(70)]
    first = min(x["at"] for x in given)
    open_ = [{"id": i, "company": rnd.choice(words), "amount_cr": rnd.choice(amounts), "created_at": first - dt.timedelta(hours=rnd.randint(0, 160)), "confirmed": False, "individuals": []} for i in range(5)]
    fields = ["id", "company", "amount_cr", "created_at", "confirmed", "individuals"]
    deals = schemas.conform(spark.createDataFrame([tuple(d[f] for f in fields) for d in open_], "id long, company string, amount_cr double, created_at timestamp, confirmed boolean, individuals array<string>"), schemas.STATE["deals"])
    dicts = [d | {"tokens": frozenset(d["company"].split()), "ref": f"d{d['id']}", "order": (0, d["id"]), "amount_raw": None, "seller": None, "size_source": None} for d in open_]
    want = cluster.fold(dicts, [dict(x, tokens=frozenset(x["company"].split())) for x in sorted(given, key=lambda x: (x["at"], x["seq"]))])
    got = {r.seq: r for r in cluster.cluster(as_frame(spark, given), deals).collect()}
    assert {w["seq"]: (w["deal_ref"], w["is_new"], w["fires"], w["note"], w["amount_cr"]) for w in want} == {i: (r.deal_ref, r.is_new, r.fires, r.note, r.amount_cr) for i, r in got.items()}


def test_a_common_word_makes_no_group(spark):
    """300 companies of one week with a word in common, amounts far apart: each its own group."""
    given = [report(i, f"Capital {chr(97 + i // 26)}{chr(97 + i % 26)}x", 1.2**i, 0.1 * i) for i in range(300)]
    named = as_frame(spark, given).select(cluster.names.company_tokens(F.col("company")).alias("tokens"), "amount_cr", "at")
    assert cluster.groups(named).select("component").distinct().count() == 300


def test_spellings_equal_the_scan():
    rnd = random.Random(8)
    for _ in range(60):
        given = [frozenset(rnd.sample("abcdefg", rnd.randint(1, 4))) for _ in range(rnd.randint(0, 60))]
        start = [frozenset(rnd.sample("abcdefg", rnd.randint(1, 4))) for _ in range(rnd.randint(0, 4))]
        spellings, seen = cluster.Spellings([*start, *given]), list(start)
        for s in start:
            spellings.keep(s)
        for t in given:
            hit = next((s for s in seen if t <= s or s <= t), None)
            if hit is None:
                seen.append(t)
            assert spellings.add(t) == (hit or t)


def test_100000_people_of_one_company():
    rnd = random.Random(8)
    given = [frozenset(("kumar", f"a{rnd.randrange(30_000)}", f"b{rnd.randrange(30_000)}")) for _ in range(100_000)]
    began = time.monotonic()
    spellings = cluster.Spellings(given)
    assert len({spellings.add(t) for t in given}) > 90_000
    assert time.monotonic() - began < 20


def brute_realerts(rows):
    out, last = [], {}
    for key, at, i, total in sorted((r for r in rows if r[1] is not None and r[3] is not None), key=lambda r: (str(r[0]), r[1], r[2])):
        prior = last.get(key)
        if prior is None or total >= 2 * prior[0] or at - prior[1] >= dt.timedelta(days=90):
            out.append((i, prior and prior[0]))
            last[key] = (total, at)
    return sorted(out, key=repr)


@pytest.mark.parametrize("batch", [3, 10_000])
def test_realerts(spark, batch):
    rnd = random.Random(5)
    rows = [(rnd.choice(["a", "b", None, "one"]), T0 + dt.timedelta(days=rnd.randint(0, 700)), i, rnd.choice([None, 1.0, 2.0, 3.0, 4.0, 8.0, 17.0])) for i in range(400)] + [("a", None, 400, 5.0)]
    df = spark.createDataFrame(rows, "k string, t timestamp, id long, total double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = sorted(((r.id, r.prior) for r in sales.realerts(df, ["k"], "t", "total", "id").collect()), key=repr)
        assert sales.realerts(df.limit(0), ["k"], "t", "total", "id").collect() == []
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == brute_realerts(rows)


def test_people(spark):
    s = spark.createDataFrame([(1, "AGARWAL SUNIL KUMAR", "c"), (2, "Sunil K Agarwal", "c"), (3, "Other Person", "c"), (4, "Sunil Agarwal", "d"), (5, "X", "c")], "seq long, person_name string, company_key string")
    got = {r.seq: r.person_key for r in cluster.resolve_people(s, schemas.empty(spark, "individual_sales")).collect()}
    assert got == {1: "agarwal kumar sunil", 2: "agarwal kumar sunil", 3: "other person", 4: "agarwal sunil", 5: ""}


def test_patterns(spark):
    def sale(i, person, value, days, name="P"):
        return (i, person, name, "C", "c", (T0 - dt.timedelta(days=days)).strftime("%d-%b-%Y"), value, "pit", T0 - dt.timedelta(days=days))

    rows = [sale(1, "fires", 120.0, 42), sale(2, "fires", 120.0, 20), sale(3, "fires", 120.0, 1), sale(4, "share", 200.0, 5), sale(5, "share", 60.0, 4), sale(6, "one", 300.0, 1), sale(7, "old", 200.0, 95), sale(8, "old", 100.0, 1), sale(9, "again", 260.0, 9), sale(10, "again", 259.0, 8), sale(11, "twice", 260.0, 9), sale(12, "twice", 260.0, 8)]
    alerts = [(1, "again", "c", 260.0, T0 - dt.timedelta(days=30)), (2, "twice", "c", 260.0, T0 - dt.timedelta(days=30))]
    got = sales.patterns(spark.createDataFrame(rows, schemas.STATE["individual_sales"]), spark.createDataFrame(alerts, schemas.STATE["pattern_alerts"]), F.lit(T0)).collect()
    assert {(r.person_key, r.total_cr, r.weeks) for r in got} == {("fires", 360.0, "6"), ("twice", 520.0, "1")}
    assert [s.trade_date for r in got if r.person_key == "fires" for s in r.sales] == [r[5] for r in rows[:3]]


def test_state(spark, tmp_path):
    store = state.StateStore(spark, f"file://{tmp_path}")
    q = state.enqueue_retries(store.read("classify_retry"), spark.createDataFrame([("a", "stage2"), ("b", "stage1")], "item_id string, stage string"), F.lit(T0))
    store.write("classify_retry", q)
    q = state.enqueue_retries(store.read("classify_retry"), spark.createDataFrame([("a", "stage1")], "item_id string, stage string"), F.lit(T0 + dt.timedelta(hours=1)))
    got = {r.item_id: r for r in q.collect()}
    assert (got["a"].stage, got["a"].attempts, got["a"].first_failed_at) == ("stage2", 2, T0) and got["b"].attempts == 1
    store.put("k", "1")
    store.put("k", "2")
    assert store.get("k") == "2" and store.version("kv_state") == 2 and store.get("none") is None
    old = spark.createDataFrame([(1, "x")], "k int, v string")
    assert sorted(map(tuple, state.insert_absent(old, spark.createDataFrame([(1, "y"), (2, "b"), (2, "a")], "k int, v string"), ["k"], F.col("v")).collect())) == [(1, "x"), (2, "a")]


def test_sizes(spark):
    m = sizing.ticker_map(spark.createDataFrame([("A", "Acme Steel Ltd"), ("B", "Beta One"), ("C", "Beta One Ltd")], "symbol string, name string"), "symbol", ".NS")
    assert [tuple(r) for r in m.collect()] == [("acme steel", "A.NS")]
    rows = [(1, None, 10000.0, "sells 10% stake", "UNKNOWN", ""), (2, None, 10000.0, "sells stake", "UNKNOWN", ""), (3, None, 300.0, "sells stake", "UNKNOWN", ""), (4, 249.0, None, "", "UNKNOWN", ""), (5, None, None, "", "UNDER_100", "size of firm"), (6, None, None, "", "UNDER_100", " No Information "), (7, None, None, "", "OVER_2000", "x")]
    df = spark.createDataFrame(rows, "i int, amount_cr double, cap double, t string, size_band string, size_basis string").withColumn("size", F.when(F.col("amount_cr").isNull(), sizing.computed_size(F.col("cap"), F.col("t"))))
    got = [(r.amount_cr, r.size_source, r.rule) for r in sizing.size_gates(df).orderBy("i").collect()]
    assert got == [(1000.0, "computed", None), (None, "mcap_plausible", None), (None, "mcap_plausible", "Rule 8"), (249.0, "stated", "Rule 8"), (None, "unknown", "Rule S"), (None, "unknown", None), (None, "band", None)]


def test_feeds(spark):
    doc = "<rss><item><title>A &amp; B</title><link>http://x/1</link><description><![CDATA[d]]></description></item><item></item><entry><title>T</title><link href='http://y'/></entry><item><title>only"
    got = feeds.rss(spark.createDataFrame([(doc,)], "value string"), "S", "q").collect()
    assert [(r.id, r.title, r.description, r.source_query) for r in got] == [("http://x/1", "A & B", "d", "q"), ("http://y", "T", "", "q")]
    raw = {"BULK_DEALS_DATA": [{"date": "01-Jul-2026", "symbol": "S", "clientName": "C", "buySell": "sell", "qty": "1,00,000", "watp": "2,500.00"}, {"symbol": "S"}, {"symbol": "S", "clientName": "C", "buySell": "BUY", "qty": "x", "watp": "1"}], "BLOCK_DEALS_DATA": []}
    deals = feeds.large_deals(spark.createDataFrame([(json.dumps(raw),)], "j string").select(F.from_json("j", schemas.LARGE_DEALS).alias("d")).select("d.*")).collect()
    assert [(r.value_cr, r.buy_sell, r.deal_type) for r in deals] == [(25.0, "SELL", "bulk deal"), (None, "BUY", "bulk deal")]
    pit = [{"date": "", "intimDt": "d", "symbol": "S", "personName": "P", "category": " Promoter ", "acqMode": "Market Sale", "secValue": "1,00,00,000"}, {"symbol": "S"}, "not json"]
    got = feeds.disclosures(spark.createDataFrame([(json.dumps(p) if isinstance(p, dict) else p,) for p in pit], "value string")).collect()
    assert [(r.trade_date, r.company, r.category, r.value_cr) for r in got] == [("d", "S", "promoter", 1.0)]
    bse = {"Table": [{"SUBCATNAME": "Acquisition", "HEADLINE": "H", "SLONGNAME": "Acme", "NEWSID": "1"}, {"SUBCATNAME": "Board Meeting acquisition"}]}
    got = feeds.bse_filings(spark.createDataFrame([(json.dumps(bse),)], "j string").select(F.from_json("j", schemas.FILING).alias("d")).select("d.*")).collect()
    assert [(r.id, r.title) for r in got] == [("BSE:1", "Acme: H")]
    page = spark.createDataFrame([("<a href='/d.html'>Draft  <b>offer</b></a><a href='http://z'>News</a><a href='q'></a>",)], "html string")
    assert [(r.title, r.url) for r in feeds.sebi_listing(page).collect()] == [("Draft offer", "https://www.sebi.gov.in/d.html")]
    assert feeds.plan_sources("auto", dt.datetime(2026, 7, 1, 9, 0)) == ("news", "press", "bse", "nse", "sebi") and feeds.plan_sources("auto", dt.datetime(2026, 7, 1, 3)) == ()


def test_model_batches(spark):
    assert classify.parse_array('x [{"a":1}] y', 2) == [{"a": 1}, {}]
    items = spark.createDataFrame([(i, "p") for i in range(60)], "seq int, prompt string")

    def call(prompts):
        if len(prompts) < 25:
            raise RuntimeError("down")
        return json.dumps([{"neg": True, "r": "3"}])

    got = classify.ask(items, call, ["seq"]).withColumn("v", classify.stage1_verdict(F.col("reply"))).orderBy("seq").collect()
    assert [r.failed for r in got] == [False] * 50 + [True] * 10
    assert [(r.v.neg, r.v.rule) for r in got[:2]] == [(True, 3), (False, None)]


def test_query_attribution_empty(spark):
    stats = reports.query_stats(*(schemas.empty(spark, n) for n in ("item_queries", "deal_members", "items", "deals")), F.lit(T0))
    assert reports.configured_query_stats(spark, ("a", "b"), stats).collect() == [("a", 0, 0), ("b", 0, 0)]
