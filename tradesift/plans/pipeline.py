"""The two jobs end to end: news and filings, and confirmed trades with split-up patterns.

Each is a function of its input, the state store, the classifier, an explicit ``as_of`` and a config. State is committed
at the end, all tables at once, after the sink took the alerts: if the sink refuses or the run dies, the same items are
due again. A dry run commits nothing."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tradesift import schemas
from tradesift.config import DEFAULT, Config
from tradesift.functions import dates, format, names, text
from tradesift.operators import classify, cluster, dedup, filters, numbering, sales, sizing, state
from tradesift.sources import feeds

Sink = Callable[[DataFrame], bool]
#: Takes a message to the operator.
Notify = Callable[[str], None]


@dataclass
class Outcome:
    alerts: DataFrame | None = None
    funnel: dict[str, int] = field(default_factory=dict)
    sizes: dict[str, int] = field(default_factory=dict)
    failed: int = 0
    sent: bool = False
    health: str | None = None


def _suppressed(df: DataFrame, rule: Column, gate: str, at: Column, amount: Column | None = None) -> DataFrame:
    none = F.lit(None)
    return df.select("title", "url", rule.alias("rule"), (none if amount is None else amount).cast("double").alias("amount_cr"), none.cast("string").alias("amount_raw"), F.lit(gate).alias("gate"), at.alias("created_at"))


def run_news(
    items: DataFrame,
    store: state.StateStore,
    model: classify.Classifier,
    as_of: datetime,
    sink: Sink | None = None,
    nse: DataFrame | None = None,
    bse: DataFrame | None = None,
    quotes: DataFrame | None = None,
    config: Config = DEFAULT,
    mode: str = "fast",
    dry: bool = False,
    limit: int | None = None,
    notify: Notify | None = None,
) -> Outcome:
    """``items``: of schemas.ITEM with seq (dense, in feed order). ``nse``/``bse``: of sizing.ticker_map. ``notify`` gets the
    warning when the classifier goes down and the message when it is back."""
    spark, at, out = items.sparkSession, F.lit(as_of).cast("timestamp"), Outcome()
    no_map = spark.createDataFrame([], "name_key string, ticker string")
    nse, bse = nse if nse is not None else no_map, bse if bse is not None else no_map
    hold = dedup.stored  # each stage is written once: no model is asked twice, plans stay small, a lost executor costs little
    n: dict[str, int] = {}  # what was counted while stages were written

    writes: dict[str, DataFrame] = {}  # tables written anew
    adds: dict[str, DataFrame] = {}  # rows appended
    known = store.read("items")  # read where it is needed, and then only its ids or the window's titles
    valid = counted(items.filter(F.coalesce("id", F.lit("")) != ""), n, fetched=F.lit(True))
    queries = valid.filter(F.coalesce("source_query", F.lit("")) != "").select(F.col("id").alias("item_id"), F.col("source_query").alias("query"), at.alias("created_at"))
    writes["item_queries"] = state.prune(state.insert_absent(store.read("item_queries"), queries, ["item_id", "query"], F.col("created_at")), "created_at", at, config.item_query_days)
    fresh = dedup.unseen(valid.withColumn("fetched_at", at), known)
    marked = counted(fresh.withColumn("noise", filters.structural_noise(F.col("url"), F.col("title"), F.col("description"))), n, fresh=F.lit(True), structural_dropped=F.col("noise"))
    live, noise_log = filters.apply_gate(marked, "noise", "structural", F.col("url"), at, config)
    history = known.filter(F.col("fetched_at") >= at - F.make_dt_interval(F.lit(0), F.lit(config.dedup_hours))).select("title_norm")
    judged = counted(dedup.title_duplicates(live, history, config), n, title_deduped=F.col("is_duplicate"))
    adds["items"] = judged
    dup = judged.filter("is_duplicate")
    adds["title_dedup_log"] = state.with_ids(store.read("title_dedup_log"), dup.select("title", "url", "matched_title", "similarity", at.alias("created_at"), "seq"), "seq")
    candidates = judged.filter("NOT is_duplicate") if config.enforce else judged
    company = F.when(F.col("source") == "BSE", F.split_part("title", F.lit(":"), F.lit(1)))
    capped = sizing.market_caps(sizing.resolve_tickers(candidates, company, nse, bse), store.read("market_caps"), at, quotes, config).withColumn("small", filters.filing_mcap_gate(F.col("source"), F.col("market_cap_cr"), config))
    capped = counted(capped, n, bse_mcap_gated=F.col("small"))
    asked_tickers = capped.select("ticker")
    capped = capped.drop("ticker")
    big, mcap_log = filters.apply_gate(capped, "small", "bse_mcap", F.col("market_cap_cr"), at, config)
    stated = big.drop("market_cap_cr").withColumn("stated_cr", text.gated_amount(F.col("title"), F.col("description"), config=config))
    gated = counted(stated.withColumn("stated_low", filters.stated_low(F.col("stated_cr"), config)), n, pre_api_gated=F.col("stated_low"))
    ready, amount_log = filters.apply_gate(gated, "stated_low", "pre_api_amount", F.lit("below threshold"), at, config)
    # The retry queue joins again at the stage it failed at.
    queue = store.read("classify_retry")
    expired, queue = state.expire_retries(queue, known, at, config)
    # Behind all items of the run, the longest waiting first.
    again = lambda stage: numbering.numbered(state.pending_retries(queue, known, stage), [F.col("first_failed_at"), F.col("item_id")], hold).select(F.col("item_id").alias("id"), "source", "title", "url", "description", (F.col("place") + (1 << (40 if stage == "stage1" else 41))).alias("seq"))
    slim = ["id", "source", "title", "url", "description", "seq"]
    ready = ready.select(*slim)
    prompted = lambda df: df.withColumn("prompt", classify.prompt(F.col("title"), F.col("description"), config))
    one = prompted(ready.filter("source <> 'SEBI'").unionByName(again("stage1")))
    asked1 = counted(classify.ask(one, model.stage1, ["seq", "id"], config), n, reached_stage1=F.lit(True), failed1=F.col("failed"))
    routed1 = hold(classify.route_stage1(asked1.withColumn("verdict", classify.stage1_verdict(F.col("reply"))), config))
    two = prompted(ready.filter("source = 'SEBI'").unionByName(routed1.filter("route = 'pass'").select(*slim)).unionByName(again("stage2")))
    asked2 = counted(classify.ask(two, model.stage2, ["seq", "id"], config), n, reached_stage2=F.lit(True), failed2=F.col("failed"))
    routed2 = hold(classify.route_stage2(asked2.withColumn("result", classify.stage2_result(F.col("reply")))))
    passed = routed2.filter("route = 'pass'").select(*slim, "result.*")
    sized = sizing.market_caps(sizing.resolve_tickers(passed, F.col("company"), nse, bse), store.read("market_caps"), at, quotes, config)
    sized = sized.withColumn("size", F.when(F.col("amount_cr").isNull(), sizing.computed_size(F.col("market_cap_cr"), F.col("title"), F.col("description"))))
    final = counted(sizing.size_gates(sized, config), n, **{f"size {c}": F.col("rule").isNull() & (F.col("size_source") == c) for c in sizing.SIZE_SOURCES})
    if quotes is not None:
        adds["market_caps"] = sizing.fetched(asked_tickers.unionByName(final.select("ticker")), store.read("market_caps"), at, quotes, config)
    deals = store.read("deals")
    reports = final.filter("rule IS NULL").select(
        "seq", "title", "url", "source", F.coalesce(F.nullif("company", F.lit("")), "title").alias("company"), "amount_cr", "amount_raw", "individuals", "seller", "deal_type", "confidence", "one_line",
        "size_source", "size_band", F.lit(False).alias("confirmed"), at.alias("at"),
    )
    decided = hold(cluster.cluster(reports, deals, config))
    new_deals, members, alerts = deal_changes(reports, decided, deals, at)
    new_deals, members = hold(new_deals), hold(members)
    writes["deals"] = new_deals
    adds["deal_members"] = state.with_ids(store.read("deal_members"), members, "seq")
    # Every named individual of a firing deal is a sale of its own.
    firing = decided.filter("fires").select("seq", "company", "individuals", "amount_cr")
    people = sales.sales_of_deal(firing).select((F.col("seq") * 1000 + F.row_number().over(_by("seq"))).alias("seq"), "person_name", "company", "company_key", F.lit(None).cast("string").alias("trade_date"), "value_cr")
    adds["individual_sales"] = recorded_sales(store.read("individual_sales"), people, "news", at)
    low = F.lit("Rule 8")
    dropped = [
        _suppressed(capped.filter("small"), F.lit("Rule M"), "pre-api", at) if config.enforce else None,
        _suppressed(gated.filter("stated_low"), low, "pre-api", at, F.col("stated_cr")) if config.enforce else None,
        _suppressed(routed1.filter("route = 'suppress'"), F.col("rule"), "model", at),
        _suppressed(routed2.filter("route = 'suppress'"), F.col("rule"), "model", at, F.col("result.amount_cr")),
        _suppressed(final.filter("rule IS NOT NULL"), F.col("rule"), "model", at, F.col("amount_cr")),
        _suppressed(expired, F.lit("Rule X"), "retry-expired", at),
    ]
    rows = dedup_union([d for d in dropped if d is not None])
    adds["suppressed"] = state.with_ids(store.read("suppressed"), rows, "title", "url", "rule")
    logs = dedup_union([noise_log, mcap_log, amount_log])
    adds["prefilter_shadow"] = state.with_ids(store.read("prefilter_shadow"), logs, "filter", "url")
    failures = routed1.filter("failed").select(F.col("id").alias("item_id"), F.lit("stage1").alias("stage")).unionByName(routed2.filter("failed").select(F.col("id").alias("item_id"), F.lit("stage2").alias("stage")))
    succeeded = routed1.filter("NOT failed").select(F.col("id").alias("item_id")).unionByName(routed2.filter("NOT failed").select(F.col("id").alias("item_id"))).join(failures.select("item_id"), "item_id", "left_anti")
    left = counted(state.delete_keys(state.enqueue_retries(queue, failures, at), succeeded, ["item_id"]), n, held=F.lit(True))
    writes["classify_retry"] = left

    out.alerts = counted(alerts.orderBy("seq").limit(limit) if limit is not None else alerts.orderBy("seq"), n, alerted=F.lit(True))
    out.funnel = {"fetched": n["fetched"], "already_seen": n["fetched"] - n["fresh"]} | {k: n[k] for k in ("structural_dropped", "title_deduped", "bse_mcap_gated", "pre_api_gated", "reached_stage1", "reached_stage2", "alerted")}
    out.sizes = {c: n[f"size {c}"] for c in sizing.SIZE_SOURCES if n[f"size {c}"]}
    out.failed = n["failed1"] + n["failed2"]
    reasons = []
    if out.failed:
        reasons = asked1.select("reason").unionByName(asked2.select("reason")).filter("reason IS NOT NULL").agg(F.slice(F.array_sort(F.collect_set("reason")), 1, 3)).first()[0]
    changes, out.health = classifier_health(store, reasons, n["reached_stage1"] + n["reached_stage2"] - out.failed, n["held"], as_of, config)
    out.sent = True if dry or sink is None else bool(sink(out.alerts))
    if not dry and out.sent:
        run = spark.createDataFrame([{"mode": mode, **out.funnel}], "mode string, " + ", ".join(f"{k} long" for k in out.funnel)).withColumn("created_at", at)
        adds["funnel_runs"] = state.with_ids(store.read("funnel_runs"), run, "mode")
        if changes:
            writes["kv_state"] = store.values(changes)
        store.commit(writes, adds)
    elif not dry and changes:  # the run is due again, but what was said of the classifier stands
        store.commit({"kv_state": store.values(changes)}, {})
    if out.health and notify is not None and not dry:
        notify(out.health)
    return out


def run_feeds(
    readers: dict[str, Callable[[], DataFrame]],
    mode: str,
    store: state.StateStore,
    model: classify.Classifier,
    as_of: datetime,
    now_ist: datetime | None = None,
    **more,
) -> tuple[Outcome, dict[str, str]]:
    """A news job from its feeds: those that ``mode`` plans are read, each by itself, and their items judged in one run. A
    feed that fails while it is read counts as empty. Returns the outcome and, by feed, the reason of a failure.

    ``readers``: for a feed's name what gives its items (of schemas.ITEM), like ``feeds.landed``; feeds without a reader are
    left out. ``more`` goes to ``run_news``."""
    spark, errors = store.spark, {}
    none = lambda: spark.createDataFrame([], schemas.ITEM)
    parts = [isolated(name, lambda name=name: dedup.stored(schemas.conform(readers[name](), schemas.ITEM)), none, errors).withColumn("_feed", F.lit(i)) for i, name in enumerate(feeds.plan_sources(mode, now_ist)) if name in readers]
    items = feeds.union_all(parts or [none().withColumn("_feed", F.lit(0))])
    seq = numbering.numbered(items, [F.col("_feed"), F.col("id"), F.col("title"), F.col("source_query")], dedup.stored, "seq").drop("_feed")
    return run_news(seq, store, model, as_of, mode=mode, **more), errors


def counted(df: DataFrame, into: dict[str, int], **conditions: Column) -> DataFrame:
    """``df`` stored; how many of its rows meet each condition is observed while it is written, not in a pass of its own."""
    seen = Observation()
    held = dedup.stored(df.observe(seen, *[F.count_if(c).alias(name) for name, c in conditions.items()]))
    into.update(seen.get)
    return held


def _by(column: str):
    from pyspark.sql import Window

    return Window.partitionBy(column).orderBy("person_name")


def dedup_union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def deal_changes(reports: DataFrame, decided: DataFrame, deals: DataFrame, at: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(deals after the run, members to add, alerts with text) of cluster decisions."""
    fresh = state.with_ids(deals, decided.filter("is_new").select("deal_ref", F.col("seq").alias("first_seq")), "first_seq")
    last = dedup.first_of(decided, ["deal_ref"], F.col("seq").desc()).select("deal_ref", *[F.col(c).alias(f"_{c}") for c in ("amount_cr", "amount_raw", "individuals", "seller", "size_source", "confirmed")])
    opened = fresh.join(last, "deal_ref").join(reports.withColumnRenamed("seq", "first_seq"), "first_seq")
    created = opened.select(
        "id", names.deal_key(F.col("company")).alias("deal_key"), "company", "deal_type", F.col("_amount_cr").alias("amount_cr"), F.col("_amount_raw").alias("amount_raw"), F.col("_individuals").alias("individuals"),
        F.col("_seller").alias("seller"), "confidence", "one_line", "source", "url", at.alias("created_at"), at.alias("updated_at"), F.col("_size_source").alias("size_source"), "size_band", F.col("_confirmed").alias("confirmed"),
    )
    touched = last.filter("deal_ref LIKE 'd%'").withColumn("_id", F.substr("deal_ref", F.lit(2)).cast("long"))
    over = {c: F.when(F.col("_id").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)) for c in ("amount_cr", "amount_raw", "individuals", "seller", "size_source", "confirmed")} | {"updated_at": F.when(F.col("_id").isNotNull(), at).otherwise(F.col("updated_at"))}
    old = deals.join(touched, deals["id"] == F.col("_id"), "left").select(*[over.get(c, F.col(c)).alias(c) for c in deals.columns])
    ids = decided.select("seq", "deal_ref", "is_new", "fires", "note").join(fresh.select("deal_ref", F.col("id").alias("_new")), "deal_ref", "left").withColumn("deal_id", F.coalesce("_new", F.substr("deal_ref", F.lit(2)).cast("long")))
    members = ids.join(reports.select("seq", "title", "url"), "seq").select("seq", "deal_id", "title", "url", at.alias("attached_at"))
    stand = decided.select("seq", *[F.col(c) for c in ("amount_cr", "individuals", "seller", "size_source", "company")])
    fired = ids.filter("fires").join(reports.drop("amount_cr", "individuals", "seller", "size_source", "company", "amount_raw", "confirmed"), "seq").join(stand, "seq").withColumn("is_update", ~F.col("is_new"))
    alerts = fired.withColumn("text", format.alert({c: F.col(c) for c in ("confidence", "company", "is_update", "deal_type", "amount_cr", "size_source", "size_band", "one_line", "individuals", "seller", "source", "url", "note")}))
    return old.unionByName(schemas.conform(created, schemas.STATE["deals"])), members, alerts.select("seq", "deal_id", "is_update", "company", "amount_cr", "note", "text")


def recorded_sales(before: DataFrame, rows: DataFrame, source: str, at: Column) -> DataFrame:
    """``rows`` (seq, person_name, company, company_key, trade_date, value_cr) as new rows of individual_sales ``before``,
    people resolved."""
    resolved = cluster.resolve_people(rows, before)
    numbered = state.with_ids(before, resolved.withColumn("source", F.lit(source)).withColumn("created_at", at), "seq")
    return schemas.conform(numbered, schemas.STATE["individual_sales"])


def run_trades(
    trades: DataFrame | None,
    disclosures: DataFrame | None,
    store: state.StateStore,
    model: classify.Classifier,
    as_of: datetime,
    sink: Sink | None = None,
    config: Config = DEFAULT,
    dry: bool = False,
) -> dict[str, DataFrame]:
    """confirmed: alert texts of large single trades; patterns: of split-up sales; errors: stage, reason. ``trades``: of
    schemas.TRADE, ``disclosures``: of schemas.DISCLOSURE, None for a feed that was not read. A feed that fails while it is
    read counts as empty, and the others go on. Trades are marked seen and recorded whatever their size. What a sink
    refuses is due again: of confirmed trades the whole run, of patterns their alerts."""
    at = F.lit(as_of).cast("timestamp")
    spark = store.spark
    hold, seen, errors = dedup.cut, store.read("items"), {}

    def new_rows(stage: str, feed: DataFrame | None, ddl: str, id_: Column, first: int) -> DataFrame:
        """Rows not seen before, numbered by day of trade and then by id."""
        given = feed if feed is not None else spark.createDataFrame([], ddl)
        rows = lambda df: numbering.numbered(dedup.unseen(df.withColumn("id", id_).withColumn("fetched_at", at), seen, order=("id",)), [dates.parse_trade_date(F.col("trade_date")), F.col("id")], hold)
        return isolated(stage, lambda: hold(rows(given).withColumn("seq", F.col("place") + first).drop("place")), lambda: hold(rows(spark.createDataFrame([], ddl)).withColumn("seq", F.col("place")).drop("place")), errors)

    t = new_rows("trades", trades, schemas.TRADE, sales.trade_id(), 0)
    d = new_rows("disclosures", disclosures, schemas.DISCLOSURE, sales.disclosure_id(), 1 << 40)
    chosen = sales.selected_trades(t, model.sellers)
    rows = chosen.select("seq", F.col("client_name").alias("person_name"), F.col("security_name").alias("company"), "trade_date", "value_cr", "deal_type", "exchange", "quantity", "price").unionByName(
        sales.selected_disclosures(d).select("seq", "person_name", "company", "trade_date", "value_cr", F.lit("PIT disclosure").alias("deal_type"), F.lit("NSE").alias("exchange"), F.lit(None).cast("double").alias("quantity"), F.lit(None).cast("double").alias("price"))
    )
    rows = hold(rows.withColumn("company_key", names.deal_key(F.col("company"))))
    before = store.read("individual_sales")
    recorded = hold(recorded_sales(before, rows.select("seq", "person_name", "company", "company_key", "trade_date", "value_cr"), "confirmed", at))
    total = before.unionByName(recorded)
    deals = store.read("deals")
    reports = rows.filter(F.col("value_cr") >= config.threshold).select(
        "seq", F.concat("company", F.lit(" "), "deal_type").alias("title"), F.lit("").alias("url"), F.col("exchange").alias("source"), "company", F.col("value_cr").alias("amount_cr"), F.lit(None).cast("string").alias("amount_raw"),
        F.array("person_name").alias("individuals"), F.col("person_name").alias("seller"), "deal_type", F.lit("high").alias("confidence"), F.lit("").alias("one_line"), F.lit("stated").alias("size_source"),
        F.lit(None).cast("string").alias("size_band"), F.lit(True).alias("confirmed"), at.alias("at"),
    )
    decided = hold(cluster.cluster(reports, deals, config))
    new_deals, members, _ = deal_changes(reports, decided, deals, at)
    fired = decided.filter("fires").select("seq", (~F.col("is_new")).alias("is_update")).join(rows, "seq")
    confirmed = fired.withColumn("text", format.confirmed_alert({"security_name": F.col("company"), "client_name": F.col("person_name")} | {c: F.col(c) for c in ("is_update", "deal_type", "value_cr", "quantity", "price", "trade_date", "exchange")})).select("seq", "company", "value_cr", "is_update", "text")
    pattern_columns = "person_key string, company_key string, total_cr double, n long, text string"

    def pattern() -> DataFrame:
        found = sales.patterns(total, store.read("pattern_alerts"), at, config=config)
        return hold(found.withColumn("text", format.pattern_alert(F.col("person_name"), F.col("company"), F.col("total_cr"), F.col("sales"), F.col("weeks"))))

    out = {"confirmed": hold(confirmed), "patterns": isolated("patterns", pattern, lambda: spark.createDataFrame([], pattern_columns), errors)}
    out["errors"] = spark.createDataFrame(list(errors.items()), "stage string, reason string")
    if dry or not (sink is None or sink(out["confirmed"])):
        return out
    writes = {"deals": new_deals}
    adds = {"items": t.select("id", "fetched_at").unionByName(d.select("id", "fetched_at")), "individual_sales": recorded, "deal_members": state.with_ids(store.read("deal_members"), members, "seq")}
    if not store.get(BACKFILLED) and not d.isEmpty():
        writes["kv_state"] = store.values({BACKFILLED: "1"})
    store.commit(writes, adds)
    # Alerts of patterns are recorded after the sink took them.
    if "patterns" not in errors and (sink is None or sink(out["patterns"])):
        fresh = out["patterns"].select("person_key", "company_key", "total_cr", at.alias("alerted_at"))
        store.append("pattern_alerts", state.with_ids(store.read("pattern_alerts"), fresh, "person_key", "company_key"))
    return out


def isolated(stage: str, make: Callable[[], DataFrame], fallback: Callable[[], DataFrame], errors: dict[str, str]) -> DataFrame:
    """What ``make`` gives, or the fallback and an entry in ``errors``: one broken stage does not stop the others."""
    try:
        return make()
    except Exception as e:
        errors[stage] = classify.failure(e)
        return fallback()


BACKFILLED, OFFSET = "pit_backfilled", "feedback_offset"
FAILING, WARNED = "classifier_failing", "classifier_warned_at"


def pit_days(store: state.StateStore, config: Config = DEFAULT) -> int:
    """The long look-back until a first run has brought data."""
    return config.pit_days if store.get(BACKFILLED) else config.pit_backfill_days


def pit_window(store: state.StateStore, as_of: datetime, config: Config = DEFAULT) -> tuple[date, date]:
    """First and last day of disclosures that a run asks for."""
    return as_of.date() - timedelta(days=pit_days(store, config)), as_of.date()


def classifier_health(store: state.StateStore, reasons: list[str], judged: int, held: int, as_of: datetime, config: Config = DEFAULT) -> tuple[dict[str, str], str | None]:
    """(changes of kv_state, message or None): a warning at most once in the cool-down, with up to three reasons of failures
    and the number of items held; and one message when something was judged again."""
    if not reasons:
        back = judged and store.get(FAILING) == "1"
        return ({FAILING: "0", WARNED: ""}, "The model answers again; what was waiting for it is asked now.") if back else ({}, None)
    last = store.get(WARNED)
    if last and (as_of - datetime.fromisoformat(last)).total_seconds() < config.warn_cooldown_minutes * 60:
        return {FAILING: "1"}, None
    lines = "\n".join(f"- {r}" for r in sorted(set(reasons))[:3])
    return {FAILING: "1", WARNED: as_of.isoformat()}, f"No answers from the model. {held} item(s) wait in the queue, nothing goes out unjudged. Causes:\n{lines}"


#: Marks a rated message: ``None`` for a press that could not be read.
Acknowledge = Callable[[int, str | None, str | None], None]


def run_feedback(updates: DataFrame, store: state.StateStore, as_of: datetime, acknowledge: Acknowledge | None = None, dry: bool = False) -> DataFrame:
    """Button presses since the last run (update_id, chat_id, deal_id, verdict): verdicts are stored together with the next
    offset, then each press is acknowledged (update_id, chat_id, verdict). A dry run only shows them. An acknowledgement
    that fails is not tried again; the verdict stands."""
    presses = dedup.cut(feeds.callbacks(updates, int(store.get(OFFSET) or 0) - 1))
    if dry or presses.isEmpty():
        return presses
    at = F.lit(as_of).cast("timestamp")
    rated = presses.filter("verdict IS NOT NULL AND deal_id IS NOT NULL").withColumn("created_at", at)
    last = presses.agg(F.max("update_id")).first()[0]
    store.commit({"kv_state": store.values({OFFSET: str(last + 1)})}, {"feedback": state.with_ids(store.read("feedback"), rated, "update_id")})
    if acknowledge is not None:  # as many as people pressed since the last run
        for r in presses.orderBy("update_id").toLocalIterator():
            acknowledge(r["update_id"], r["chat_id"], r["verdict"])
    return presses
