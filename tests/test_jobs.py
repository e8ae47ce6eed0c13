"""Whole jobs: twice over one state, with a model that fails once."""

import datetime as dt
import json

from pyspark.sql import functions as F

from tradesift import schemas
from tradesift.operators import classify, state
from tradesift.plans import pipeline
from tradesift.sources import feeds

T0 = dt.datetime(2026, 7, 1, 12)


def news(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq long, id string, source string, title string, url string, description string, source_query string")


def test_news(spark, tmp_path):
    store = state.StateStore(spark, f"file://{tmp_path}")
    rows = [
        ("1", "press", "Acme promoter sells stake for ₹900 crore", "u1", "", "q"),
        ("2", "press", "Acme promoter sells stake for ₹900 crore - Mint", "u2", "", "q"),
        ("3", "press", "Beta promoter sells stake for ₹100 crore", "u3", "", "q"),
        ("4", "press", "Gamma issues debentures worth a lot", "u4", "", "q"),
        ("5", "press", "Live", "http://x/liveblog/1", "", "q"),
        ("", "press", "no id", "u6", "", "q"),
        ("1", "press", "again", "u7", "", "q"),
    ]
    out = pipeline.run_news(news(spark, rows), store, classify.RuleClassifier(), T0)
    f = out.funnel
    assert f == {"fetched": 6, "already_seen": 1, "structural_dropped": 1, "title_deduped": 1, "bse_mcap_gated": 0, "pre_api_gated": 1, "reached_stage1": 2, "reached_stage2": 1, "alerted": 1}
    assert f["fetched"] == f["already_seen"] + f["structural_dropped"] + f["title_deduped"] + f["bse_mcap_gated"] + f["pre_api_gated"] + f["reached_stage1"]
    assert "Rs 900cr" in out.alerts.first().text
    assert store.read("deals").count() == 1 and store.read("deal_members").count() == 1
    assert {r.rule for r in store.read("suppressed").collect()} == {"Rule 8", "Rule 1"}
    again = pipeline.run_news(news(spark, rows), store, classify.RuleClassifier(), T0 + dt.timedelta(hours=1))
    assert again.funnel["alerted"] == 0 and store.read("funnel_runs").count() == 2


def test_failed_model_is_retried(spark, tmp_path):
    class Down(classify.RuleClassifier):
        def stage1(self, prompts):
            raise RuntimeError("down")

    store = state.StateStore(spark, f"file://{tmp_path}")
    item = [("1", "press", "Acme promoter sells stake for ₹900 crore", "u1", "", "q")]
    assert pipeline.run_news(news(spark, item), store, Down(), T0).failed == 1
    assert [r.attempts for r in store.read("classify_retry").collect()] == [1]
    out = pipeline.run_news(news(spark, item), store, classify.RuleClassifier(), T0 + dt.timedelta(hours=1))
    assert out.funnel["alerted"] == 1 and store.read("classify_retry").count() == 0


def test_health_messages(spark, tmp_path):
    """One warning in the cool-down with up to three reasons, one message when it is back, none for a run without items."""
    store = state.StateStore(spark, f"file://{tmp_path}")

    def step(reasons, judged, minutes):
        changes, message = pipeline.classifier_health(store, reasons, judged, 7, T0 + dt.timedelta(minutes=minutes))
        if changes:
            store.commit({"kv_state": store.values(changes)})
        return message

    first = step(["b", "a", "a", "c", "d"], 0, 0)
    assert "7 item(s)" in first and first.endswith("- a\n- b\n- c")
    assert step(["a"], 3, 30) is None and step([], 0, 40) is None
    assert "answers again" in step([], 2, 45) and step([], 2, 50) is None
    assert step(["a"], 0, 55) is not None


def test_refused_alerts_are_due_again(spark, tmp_path):
    store = state.StateStore(spark, f"file://{tmp_path}")
    item = [("1", "press", "Acme promoter sells stake for ₹900 crore", "u1", "", "q")]
    assert not pipeline.run_news(news(spark, item), store, classify.RuleClassifier(), T0, sink=lambda df: False).sent
    assert store.read("items").count() == 0 and store.read("deals").count() == 0
    assert pipeline.run_news(news(spark, item), store, classify.RuleClassifier(), T0, sink=lambda df: df.count() == 1).sent
    assert store.read("items").count() == 1 and store.read("deals").count() == 1


def test_market_caps_are_kept(spark, tmp_path):
    """A quote is stored when it was asked for, and the second run, without quotes, finds it in the cache."""
    store = state.StateStore(spark, f"file://{tmp_path}")
    nse = spark.createDataFrame([("acme steel", "ACME.NS")], "name_key string, ticker string")
    quotes = spark.createDataFrame([("ACME.NS", 5000.04), ("OTHER.NS", 1.0)], "ticker string, market_cap_cr double")
    filing = lambda i: news(spark, [(i, "BSE", "Acme Steel: promoter sells 10% stake", f"u{i}", "", None)])
    pipeline.run_news(filing("1"), store, classify.RuleClassifier(), T0, nse=nse, quotes=quotes)
    assert [tuple(r)[:2] for r in store.read("market_caps").collect()] == [("ACME.NS", 5000.0)]
    again = pipeline.run_news(filing("2"), store, classify.RuleClassifier(), T0 + dt.timedelta(days=1), nse=nse, quotes=quotes.limit(0))
    assert again.funnel["bse_mcap_gated"] == 0 and store.read("market_caps").count() == 1


def test_a_ticker_quoted_twice(spark, tmp_path):
    """Two quotes of one ticker leave one item, at the larger."""
    store = state.StateStore(spark, f"file://{tmp_path}")
    nse = spark.createDataFrame([("acme steel", "ACME.NS")], "name_key string, ticker string")
    quotes = spark.createDataFrame([("ACME.NS", 5000.0), ("ACME.NS", 4000.0), ("ACME.NS", None)], "ticker string, market_cap_cr double")
    filing = news(spark, [("1", "BSE", "Acme Steel: promoter sells 10% stake", "u", "", None)])
    out = pipeline.run_news(filing, store, classify.RuleClassifier(), T0, nse=nse, quotes=quotes)
    assert out.funnel["fetched"] == 1 and out.funnel["reached_stage1"] == 1 and store.read("items").count() == 1
    assert [r.market_cap_cr for r in store.read("market_caps").collect()] == [5000.0]


def test_warning_stands_when_the_sink_refuses(spark, tmp_path):
    """One warning in the cool-down though nothing of either run is kept."""

    class Down(classify.RuleClassifier):
        def stage1(self, prompts):
            raise RuntimeError("down")

    store, said = state.StateStore(spark, f"file://{tmp_path}"), []
    item = news(spark, [("1", "press", "Acme promoter sells stake for ₹900 crore", "u1", "", "q")])
    for minutes in (0, 15):
        out = pipeline.run_news(item, store, Down(), T0 + dt.timedelta(minutes=minutes), sink=lambda df: False, notify=said.append)
        assert not out.sent and out.failed == 1
    assert len(said) == 1 and "down" in said[0]
    assert store.read("items").count() == 0 and store.read("classify_retry").count() == 0


def test_feeds_fail_by_themselves(spark, tmp_path):
    """Landed feeds of a slow and a fast run; one is missing, one is broken."""
    base, store = tmp_path / "landed", state.StateStore(spark, f"file://{tmp_path}/state")
    rss = "<rss><item><title>{t} promoter sells stake for ₹900 crore</title><link>http://x/{t}</link></item></rss>"
    for folder, name in (("news/0", "Acme"), ("press/mint", "Beta")):
        (base / folder).mkdir(parents=True)
        (base / folder / "a.xml").write_text(rss.format(t=name))
    (base / "sebi").mkdir()
    (base / "sebi" / "a.html").write_text('<a href="/drhp/1">Gamma draft prospectus</a>')
    readers = feeds.landed(spark, f"file://{base}", ("mint",), ("stake sale",))
    readers["nse"] = lambda: spark.range(1).selectExpr("raise_error('blocked') AS id")
    seen = []

    def complete(message):
        contract, _, items = message.partition("\n\n")
        assert contract in classify.CONTRACT.values() and items.startswith("[1] ")
        rules = classify.RuleClassifier()
        prompts = [i.split("] ", 1)[1] for i in items.split("\n\n")]
        return "Here: " + (rules.stage1(prompts) if contract == classify.CONTRACT["stage1"] else rules.stage2(prompts))

    out, errors = pipeline.run_feeds(readers, "fast", store, classify.ModelClassifier(complete), T0)
    assert set(errors) == {"bse", "nse"} and "blocked" in errors["nse"]
    assert out.funnel["fetched"] == 2 and out.funnel["alerted"] == 2 and not seen
    assert {(r.source, r.source_query) for r in store.read("items").collect()} == {("Google News", "stake sale"), ("mint", None)}
    slow, errors = pipeline.run_feeds(readers, "slow", store, classify.RuleClassifier(), T0 + dt.timedelta(hours=1))
    assert errors == {} and slow.funnel["fetched"] == 1 and slow.funnel["reached_stage1"] == 0 and slow.funnel["reached_stage2"] == 1


def test_disclosures_and_masters(spark, tmp_path):
    (tmp_path / "pit").mkdir()
    (tmp_path / "pit" / "a.json").write_text("\n".join(json.dumps({"symbol": "ACME", "acqName": f"P{i}", "date": d, "secVal": "100,00,000"}) for i, d in enumerate(("30-Jun-2026", "01-Jul-2026", "20-May-2026", "soon"))))
    store = state.StateStore(spark, f"file://{tmp_path}/state")
    found = feeds.read_disclosures(spark, f"file://{tmp_path}/pit", dt.date(2026, 6, 24), dt.date(2026, 7, 1))
    assert sorted(r.person_name for r in found.collect()) == ["P0", "P1", "P3"]
    path = f"file://{tmp_path}/master"
    raw = spark.createDataFrame([(" A1 ", " Acme Steel ", 1), ("B2", None, 2), ("", "No code", 3)], "code string, company string, x int")
    feeds.refresh_master(raw, "code", "company", "symbol", path)
    assert [tuple(r) for r in feeds.read_master(spark, path, "symbol").collect()] == [("A1", "Acme Steel")]
    assert state.queue_size(store.read("classify_retry")) == 0


def test_feedback_over_two_runs(spark, tmp_path):
    store = state.StateStore(spark, f"file://{tmp_path}")
    press = lambda i, data: (i, (data, ((99,),)))
    kind = "update_id long, callback_query struct<data:string,message:struct<chat:struct<id:long>>>"
    updates = spark.createDataFrame([press(5, "fb:3:useful"), press(6, "junk"), press(7, "fb:4:noise")], kind)
    seen = []
    assert pipeline.run_feedback(updates, store, T0, lambda *r: seen.append(r), dry=True).count() == 3 and not seen
    pipeline.run_feedback(updates, store, T0, lambda *r: seen.append(r))
    assert seen == [(5, "99", "useful"), (6, "99", None), (7, "99", "noise")]
    assert sorted((r.id, r.deal_id, r.verdict) for r in store.read("feedback").collect()) == [(1, 3, "useful"), (2, 4, "noise")]
    later = updates.unionByName(spark.createDataFrame([press(8, "fb:3:already_knew")], kind))
    pipeline.run_feedback(later, store, T0)
    assert store.get(pipeline.OFFSET) == "9" and store.read("feedback").count() == 3


def test_backfill_and_broken_feeds(spark, tmp_path):
    store = state.StateStore(spark, f"file://{tmp_path}")
    broken = spark.createDataFrame([("x",)], "trade_date string").selectExpr("trade_date", *[f"raise_error('feed') AS {c}" if c == "symbol" else f"cast(null AS {t}) AS {c}" for c, t in (f.split() for f in schemas.TRADE.split(", ")[1:])])
    pit = spark.createDataFrame([("2026-06-20", "ACME", "Acme Steel", "Ravi Kumar", "promoter", "market sale", 10.0)], schemas.DISCLOSURE)
    assert pipeline.pit_days(store) == 90
    none = pipeline.run_trades(None, pit.limit(0), store, classify.RuleClassifier(), T0)
    assert none["errors"].count() == 0 and pipeline.pit_days(store) == 90
    out = pipeline.run_trades(broken, pit, store, classify.RuleClassifier(), T0)
    assert [r.stage for r in out["errors"].collect()] == ["trades"]
    assert store.read("individual_sales").count() == 1 and pipeline.pit_days(store) == 7
    assert pipeline.pit_window(store, T0) == (dt.date(2026, 6, 24), dt.date(2026, 7, 1))
    assert [(r.person_key, r.n) for r in state.distinct_people(store.read("individual_sales")).collect()] == [("kumar ravi", 1)]


def test_trades(spark, tmp_path):
    store = state.StateStore(spark, f"file://{tmp_path}")
    t = lambda client, value, qty: ("01-Jul-2026", "ACME", "Acme Steel", client, "SELL", qty, 100.0, value, "NSE", "block deal")
    trades = spark.createDataFrame([t("Ravi Kumar", 900.0, 1.0), t("SBI Mutual Fund", 900.0, 2.0), t("Asha Rao", 130.0, 3.0), t("Asha Rao", 140.0, 4.0)], schemas.TRADE)
    pit = spark.createDataFrame([("2026-06-20", "ACME", "Acme Steel", "Ravi Kumar", "promoter", "market sale", 10.0)], schemas.DISCLOSURE)
    dry = pipeline.run_trades(trades, pit, store, classify.RuleClassifier(), T0, dry=True)
    assert store.version("individual_sales") == 0
    taken = []
    out = pipeline.run_trades(trades, pit, store, classify.RuleClassifier(), T0, sink=lambda df: taken.append(df.count()) is None)
    assert taken == [1, 1]
    assert dry["confirmed"].count() == out["confirmed"].count() == 1
    assert [(r.person_name, r.total_cr) for r in out["patterns"].collect()] == [("Asha Rao", 270.0)]
    assert store.read("individual_sales").count() == 4
    again = pipeline.run_trades(trades, pit, store, classify.RuleClassifier(), T0 + dt.timedelta(days=1))
    assert again["confirmed"].count() == 0 and again["patterns"].count() == 0 and store.read("individual_sales").count() == 4


def test_streams_equal_batches(spark, tmp_path):
    from tradesift.streaming import jobs

    rows = [("p", "c", T0 + dt.timedelta(days=i), 120.0) for i in range(4)]
    df = spark.createDataFrame(rows, "person_key string, company_key string, at timestamp, value_cr double")
    df.write.parquet(f"{tmp_path}/in")
    found = jobs.pattern_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "1 day", 90, 250, 2, 0.7, 2.0)
    found.writeStream.format("memory").queryName("patterns").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert [(r.total_cr, r.n) for r in spark.table("patterns").collect()] == [(360.0, 3)]


def test_dedup_stream_keeps_keys_not_rows(spark, tmp_path):
    """Three batches: each reads what it brings, and the state store knows the keys of all."""
    from tradesift.streaming import jobs

    kind = "id string, at long, x string"
    batches = [[("a", 2, "late"), ("a", 1, "first"), ("b", 5, None), (None, 0, "n"), ("", 0, "e")], [("b", 1, "again"), ("c", None, "null first"), ("c", 3, "c")], [("a", 0, "again"), ("d", 1, "d")]]
    want = [{("a", 1, "first"), ("b", 5, None)}, {("c", None, "null first")}, {("d", 1, "d")}]
    so_far, keys = set(), 0
    for rows, new in zip(batches, want):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        query = jobs.dedup_stream(spark.readStream.schema(kind).json(f"{tmp_path}/in"), "id", ("at",), f"{tmp_path}/out", f"{tmp_path}/state")
        query.awaitTermination()
        so_far, keys = so_far | new, keys + len(new)
        got = spark.read.schema(kind).parquet(f"{tmp_path}/out").collect()
        assert len(got) == len(so_far) and {tuple(r) for r in got} == so_far
        assert sum(p["numInputRows"] for p in query.recentProgress) == len(rows)
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == keys
    assert "RocksDB" not in spark.conf.get(jobs.STATE_STORE[0], "")


def test_news_stream_equals_batches(spark, tmp_path):
    """Files one after another through the stream, and the same items at once: equal state, in order of arrival."""
    import json
    import os

    from tradesift.streaming import jobs

    titles = ["Acme promoter sells stake for ₹900 crore", "Acme promoter sells stake for ₹900 crore", "Beta founder sells shares worth ₹700 crore", "Acme promoter block deal worth ₹1,500 crore", "Gamma family sells stake for ₹800 crore"]
    rows = [{"id": f"{9 - i}", "source": "press", "title": t, "url": f"u{i}", "description": "", "source_query": "q"} for i, t in enumerate(titles)]
    os.makedirs(tmp_path / "in")
    for i, part in enumerate((rows[:3], rows[3:])):
        (tmp_path / "in" / f"{9 - i}.json").write_text("\n".join(map(json.dumps, part)))
        os.utime(tmp_path / "in" / f"{9 - i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    one, two = (state.StateStore(spark, f"file://{tmp_path}/{k}") for k in "ab")
    jobs.news_stream(spark, f"{tmp_path}/in", one, classify.RuleClassifier(), f"{tmp_path}/c", clock=lambda: T0).awaitTermination()
    pipeline.run_news(news(spark, [tuple(r.values()) for r in rows]), two, classify.RuleClassifier(), T0)
    for name, columns in {"deals": ("id", "company", "amount_cr", "url"), "deal_members": ("id", "deal_id", "url"), "title_dedup_log": ("id", "url"), "items": ("id", "title_norm")}.items():
        a, b = (sorted(map(tuple, s.read(name).select(*columns).collect())) for s in (one, two))
        assert a == b and a, name
    assert [r.url for r in one.read("deal_members").orderBy("id").collect()][0] == "u0"


def test_commits_are_whole(spark, tmp_path):
    store = state.StateStore(spark, f"file://{tmp_path}")
    row = lambda k: spark.createDataFrame([(k, "v")], schemas.STATE["kv_state"])
    store.commit({"kv_state": row("a")})
    broken = row("b").selectExpr("key", "raise_error('lost') AS value")
    try:
        store.commit({"classify_retry": spark.createDataFrame([], schemas.STATE["classify_retry"])}, {"kv_state": broken})
    except Exception:
        pass
    assert [r.key for r in store.read("kv_state").collect()] == ["a"] and store.version("classify_retry") == 0
    store.MOST_PARTS = 3
    for k in "bcdef":
        store.append("kv_state", row(k))
    assert sorted(r.key for r in store.read("kv_state").collect()) == list("abcdef") and store.version("kv_state") == 6


def test_session_warms_up_once():
    import http.server
    import threading

    from tradesift.sources.session import Session

    asked = []

    class Site(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append((self.path, self.headers.get("Cookie")))
            self.send_response(200)
            self.send_header("Set-Cookie", "k=1")
            self.end_headers()
            self.wfile.write(b"ok")

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    home = f"http://127.0.0.1:{server.server_port}"
    s = Session(f"{home}/", pause=0)
    assert s.get(f"{home}/a") == s.get(f"{home}/b") == b"ok"
    assert asked == [("/", None), ("/a", "k=1"), ("/b", "k=1")]
    server.shutdown()
