"""The engine's operators over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradesift import schemas
from tradesift.config import TRANSACTION_WORDS, VALUATION_WORDS
from tradesift.functions import dates, format, names, text
from tradesift.operators import classify, cluster, dedup, filters, reports, sales, setjoin, sizing, state
from tradesift.sources import feeds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a query under its function's name, with its SQL if SQL can express it."""

    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def instant(c: str) -> Column:
    return F.col(c).cast("timestamp")


def at(value: str) -> Column:
    return F.lit(value).cast("timestamp")


# ---- windows over trades


@query(
    """
    WITH w AS (
      SELECT o_orderkey, o_custkey, o_orderdate,
             sum(o_totalprice) OVER r AS total, count(*) OVER r AS n, max(o_totalprice) OVER r AS largest
      FROM orders
      WINDOW r AS (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND CURRENT ROW))
    SELECT o_orderkey, o_custkey, o_orderdate, round(total, 2) AS total, n, largest
    FROM w WHERE total >= 600000 AND n >= 2 AND largest <= 0.7 * total
    """
)
def salami_rolling_90d(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    found = sales.rolling(orders, ["o_custkey"], "o_orderdate", "o_totalprice", 90, 600000, 2, 0.7)
    return found.withColumn("total", F.round("total", 2)).drop("o_totalprice")


@query(
    """
    WITH RECURSIVE w AS (
      SELECT o_orderkey, o_custkey, o_orderdate, round(sum(o_totalprice) OVER r, 2) AS total, count(*) OVER r AS n, max(o_totalprice) OVER r AS largest
      FROM orders WINDOW r AS (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND CURRENT ROW)),
    q AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM w WHERE total >= 250000 AND n >= 2 AND largest <= 0.7 * total),
    f AS (
      SELECT o_orderkey, o_custkey, total, k, true AS due, NULL::DOUBLE AS prior, total AS last_total, o_orderdate AS last_at FROM q WHERE k = 1
      UNION ALL
      SELECT o_orderkey, o_custkey, total, k, due, prior, CASE WHEN due THEN total ELSE prior END, CASE WHEN due THEN o_orderdate ELSE last_at END FROM (
        SELECT q.o_orderkey, q.o_custkey, q.o_orderdate, q.total, q.k, f.last_total AS prior, f.last_at, q.total >= 2 * f.last_total OR q.o_orderdate >= f.last_at + INTERVAL 90 DAYS AS due
        FROM f JOIN q ON q.o_custkey = f.o_custkey AND q.k = f.k + 1))
    SELECT o_orderkey, o_custkey, total, prior FROM f WHERE due
    """
)
def salami_realert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the orders at which a customer's trailing 90 days qualify, those that alert again: against the last alert, not the
    last row."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    found = sales.rolling(orders, ["o_custkey"], "o_orderdate", "o_totalprice", 90, 250000, 2, 0.7).withColumn("total", F.round("total", 2))
    return sales.realerts(found, ["o_custkey"], "o_orderdate", "total", "o_orderkey").select("o_orderkey", "o_custkey", "total", "prior")


@query(
    """
    WITH s AS (SELECT o_custkey, sum(o_totalprice) AS total, count(*) AS n, max(o_totalprice) AS largest FROM orders
               WHERE o_orderdate >= TIMESTAMP '2001-06-01' - INTERVAL 90 DAYS GROUP BY 1),
    l AS (SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS last_total, max(o_orderdate) AS last_at FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01' GROUP BY 1)
    SELECT 'c' || o_custkey AS person_key, round(total, 2) AS total_cr, n, largest
    FROM s LEFT JOIN l USING (o_custkey)
    WHERE round(total, 2) >= 250 AND n >= 2 AND largest <= 0.7 * round(total, 2)
      AND (last_at IS NULL OR round(total, 2) >= 2 * last_total OR last_at <= TIMESTAMP '2001-06-01' - INTERVAL 90 DAYS)
    """
)
def pattern_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    person = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    sold = o.select(F.col("o_orderkey").alias("id"), person.alias("person_key"), person.alias("person_name"), F.lit("x").alias("company"), F.lit("x").alias("company_key"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("trade_date"), F.col("o_totalprice").alias("value_cr"), instant("o_orderdate").alias("created_at"))
    past = o.filter(instant("o_orderdate") < at("2001-01-01")).select(F.col("o_orderkey").alias("id"), person.alias("person_key"), F.lit("x").alias("company_key"), F.col("o_totalprice").alias("total_cr"), instant("o_orderdate").alias("alerted_at"))
    return sales.patterns(sold, past, at("2001-06-01")).select("person_key", "total_cr", "n", "largest")


# ---- names and matches

TOKENS = """
    (SELECT p_name, count(*) AS n, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'),
     lambda w: length(w) > 1 AND w NOT IN ('private','limited','ltd','pvt','inc','corp','corporation','technologies','technology','industries','enterprises','group','holdings','india','company','co','and','the','engineering','services','solutions')))) AS t
     FROM part GROUP BY 1)
"""


@query(
    """
    WITH n AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT DISTINCT p_name || ' ' || p_brand FROM part),
    p AS (SELECT name, list_distinct(list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda w: length(w) > 1)) AS t FROM n)
    SELECT a.name AS small, b.name AS large FROM p a JOIN p b ON a.name <> b.name WHERE len(a.t) > 0 AND list_has_all(b.t, a.t)
    """
)
def name_subset_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different names, alone and with their brand, of which one contains the other."""
    part = table(spark, sf_dir, "part")
    named = part.select(F.col("p_name").alias("name")).unionByName(part.select(F.concat_ws(" ", "p_name", "p_brand").alias("name"))).distinct()
    return cluster.subset_pairs(named.withColumn("tokens", names.company_tokens(F.col("name"))), "name")


@query(
    """
    SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey
    WHERE abs(epoch_us(a.o_orderdate) - epoch_us(b.o_orderdate)) <= 168 * 3600000000
      AND a.o_totalprice > 0 AND b.o_totalprice > 0 AND abs(a.o_totalprice - b.o_totalprice) <= 0.05 * greatest(a.o_totalprice, b.o_totalprice)
    """
)
def amount_match_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An interval join: rows meet in the buckets of one window's width, so a customer's whole history never pairs up."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", (F.unix_micros(instant("o_orderdate")) / 3.6e9).alias("h"))
    bucket = F.floor(F.col("h") / 168)
    a = o.select("o_custkey", F.col("o_orderkey").alias("a"), F.col("o_totalprice").alias("va"), F.col("h").alias("ha"), bucket.alias("k"))
    b = o.select("o_custkey", F.col("o_orderkey").alias("b"), F.col("o_totalprice").alias("vb"), F.col("h").alias("hb"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("k"))
    near = a.join(b, ["o_custkey", "k"]).filter((F.col("a") < F.col("b")) & (F.abs(F.col("ha") - F.col("hb")) <= 168))
    return near.filter(names.amount_match(F.col("va"), F.col("vb"))).select("a", "b")


@query(
    f"""
    SELECT p_name, array_to_string(t, ' ') AS deal_key FROM {TOKENS}
    """
)
def deal_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_name").distinct().withColumn("deal_key", names.deal_key(F.col("p_name")))


@query(
    """
    SELECT c_custkey, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower('Mr. ' || c_name || ' Kumar, ' || c_mktsegment), '[^a-z0-9]+'),
      lambda w: length(w) > 1 AND w NOT IN ('mr','mrs','ms','miss','shri','smt','dr','kum','km','late')))), ' ') AS person_key FROM customer
    """
)
def person_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = F.concat(F.lit("Mr. "), F.col("c_name"), F.lit(" Kumar, "), F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", names.person_key(full).alias("person_key"))


@query(
    """
    SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(p_name || ' ' || p_type || ' Pvt. Ltd'), '\\b(private|limited|ltd|pvt|inc|corp|technologies|industries|enterprises)\\b', ' ', 'g'),
      '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS company FROM part
    """
)
def company_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = F.concat("p_name", F.lit(" "), "p_type", F.lit(" Pvt. Ltd"))
    return table(spark, sf_dir, "part").select("p_partkey", names.normalise_company(full).alias("company"))


KEYWORDS = "(regexp_matches(lower({c}), 'fund|mutual|amc|llp|securities|capital|advisors|advisers|partners|mauritius|pte|plc|gmbh|sicav|insurance|bank|asset management|portfolio|trustee|fpi|fii'))"


@query(
    f"""
    SELECT CASE WHEN {KEYWORDS.format(c="p_name || ' ' || p_type")} THEN 'institution'
                WHEN regexp_matches(lower(p_name || ' ' || p_type), 'ltd|limited|pvt|holdings|enterprises|trust|corp|investment|investments|global|international|ventures|equity') THEN 'ambiguous'
                ELSE 'individual' END AS seller_class, count(*) AS n FROM part GROUP BY 1
    """
)
def seller_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(names.seller_class(F.concat_ws(" ", "p_name", "p_type")).alias("seller_class")).agg(F.count("*").alias("n"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as reports on companies. A line is known by all of its columns, so only lines that agree in each are one."""
    line = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws(" ", "p_name", "p_brand").alias("company"))
    # Parquet hides how large the parts are, so the optimizer might send them all through the driver.
    return line.join(part.hint("merge"), "l_partkey").select(F.struct(*line.columns).alias("seq"), "company", F.col("l_extendedprice").alias("amount_cr"), instant("l_shipdate").alias("at"))


def _open_deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("part "), F.col("s_name")).alias("company"), F.col("s_acctbal").alias("amount_cr"))
    part = table(spark, sf_dir, "part").select((F.col("p_partkey") + 1_000_000).alias("id"), F.concat_ws(" ", "p_name", "p_brand").alias("company"), (F.col("p_retailprice") * 20).alias("amount_cr"))
    return schemas.conform(o.unionByName(part).withColumn("created_at", at("1997-03-01") + F.make_dt_interval(F.col("id").cast("int") % 400)).withColumn("confirmed", F.lit(False)).withColumn("individuals", F.array().cast("array<string>")), schemas.STATE["deals"])


@query(
    """
    WITH d AS (SELECT id, company, amount_cr, TIMESTAMP '1997-03-01' + to_days((id % 400)::INTEGER) AS created_at FROM (
        SELECT s_suppkey AS id, 'part ' || s_name AS company, s_acctbal AS amount_cr FROM supplier
        UNION ALL SELECT p_partkey + 1000000, p_name || ' ' || p_brand, p_retailprice * 20 FROM part)),
    r AS (SELECT l, p_name || ' ' || p_brand AS company, l.l_extendedprice AS amount_cr, l.l_shipdate::TIMESTAMP AS seen FROM (SELECT DISTINCT lineitem AS l FROM lineitem) JOIN part ON l.l_partkey = p_partkey),
    dt AS (SELECT *, list_filter(regexp_split_to_array(lower(company), '[^a-z0-9]+'), lambda w: length(w) > 1) AS t FROM d),
    rt AS (SELECT *, list_filter(regexp_split_to_array(lower(company), '[^a-z0-9]+'), lambda w: length(w) > 1) AS t FROM r),
    w AS (SELECT l, seen, rt.t AS t, dt.t AS u, rt.amount_cr AS a, dt.amount_cr AS b, dt.id, created_at FROM rt JOIN dt ON seen >= created_at AND seen <= created_at + INTERVAL 168 HOURS),
    m AS (SELECT l, id, created_at FROM w WHERE list_has_any(t, u) AND (
        (seen <= created_at + INTERVAL 72 HOURS AND (list_has_all(t, u) OR list_has_all(u, t))) OR (a > 0 AND b > 0 AND abs(a - b) <= 0.05 * greatest(a, b)))),
    f AS (SELECT l, arg_max(id, (created_at, id)) AS deal_id FROM m GROUP BY 1)
    SELECT unnest(l), deal_id FROM f
    """
)
def open_deal_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every line the newest deal that it matches."""
    return cluster.open_matches(_lines(spark, sf_dir), _open_deals(spark, sf_dir)).select("seq.*", "deal_id")


@query(
    """
    WITH RECURSIVE e AS (SELECT event_id AS seq, user_id AS u, value AS v, ts AS seen, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    f(u, k, seq, deals, ref, fires, news, now) AS (
      SELECT u, k, seq, [struct_pack(ref := seq, made := seen, v := v)], seq, true, '', v FROM e WHERE k = 1
      UNION ALL
      SELECT u, k, seq, CASE WHEN hit IS NULL THEN list_append(deals, struct_pack(ref := seq, made := seen, v := v)) ELSE list_transform(deals, lambda d: CASE WHEN d.ref = hit.ref THEN struct_pack(ref := d.ref, made := d.made, v := now) ELSE d END) END,
             coalesce(hit.ref, seq), hit IS NULL OR news <> '', news, now FROM (
        SELECT *, CASE WHEN hit IS NULL OR news <> '' THEN v ELSE hit.v END AS now FROM (
          SELECT *, CASE WHEN hit IS NULL OR v IS NULL THEN '' WHEN coalesce(hit.v, 0) = 0 THEN 'amount added' WHEN hit.v > 0 AND abs(v - hit.v) / hit.v > 0.2 THEN 'amount revised' ELSE '' END AS news FROM (
            SELECT e.u, e.k, e.seq, e.v, e.seen, f.deals,
                   list_filter(f.deals, lambda d: e.seen <= d.made + INTERVAL 72 HOURS OR (e.seen <= d.made + INTERVAL 168 HOURS AND e.v > 0 AND d.v > 0 AND abs(e.v - d.v) <= 0.05 * greatest(e.v, d.v)))[-1] AS hit
            FROM f JOIN e ON e.u = f.u AND e.k = f.k + 1))))
    SELECT seq, 'r' || ref AS deal_ref, ref = seq AS is_new, fires, news, now AS amount_cr FROM f
    """
)
def cluster_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event user's reports against no open deals, in order of time; SQL takes each user's one after another."""
    e = table(spark, sf_dir, "events")
    named = e.select(F.col("event_id").alias("seq"), F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("company"), F.col("value").alias("amount_cr"), instant("ts").alias("at"))
    full = schemas.conform(named.withColumn("confirmed", F.lit(False)).withColumn("individuals", F.array().cast("array<string>")), cluster.REPORT)
    return cluster.cluster(full, schemas.empty(spark, "deals")).select("seq", "deal_ref", "is_new", "fires", F.substring_index("note", " ", 2).alias("news"), "amount_cr")


@query(
    """
    SELECT s_suppkey AS seq, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(s_name), '[^a-z0-9]+'), lambda w: length(w) > 1))), ' ') AS person_key FROM supplier
    """
)
def person_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("seq"), F.col("s_name").alias("person_name"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("company_key"))
    return cluster.resolve_people(s, schemas.empty(spark, "individual_sales")).select("seq", "person_key")


# ---- joins to state


@query(
    """
    WITH j AS (SELECT c.event_id, p.event_id AS purchase_id, row_number() OVER (PARTITION BY c.event_id ORDER BY p.ts DESC, p.event_id DESC) AS r
      FROM events c JOIN events p ON c.user_id = p.user_id AND p.event_type = 'purchase' AND p.ts <= c.ts AND p.ts >= c.ts - INTERVAL 7 DAYS WHERE c.event_type = 'click')
    SELECT event_id, purchase_id FROM j WHERE r = 1
    """
)
def asof_ttl_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join of a table with itself: one range window, no join."""
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(instant("ts"))).rangeBetween(-7 * 86_400_000_000, 0)
    bought = F.max(F.when(F.col("event_type") == "purchase", F.struct("ts", "event_id"))).over(w)
    return table(spark, sf_dir, "events").withColumn("p", bought).filter("event_type = 'click' AND p IS NOT NULL").select("event_id", F.col("p.event_id").alias("purchase_id"))


@query(
    """
    WITH q AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY fetched_at DESC) AS r FROM (
        SELECT 'T' || (o_custkey % 50) AS ticker, o_totalprice AS market_cap_cr, max(o_orderdate) OVER (PARTITION BY o_orderkey) AS fetched_at, o_orderkey FROM orders)
      WHERE fetched_at >= TIMESTAMP '2001-07-15' - INTERVAL 7 DAYS),
    c AS (SELECT c_custkey, 'T' || (c_custkey % 50) AS ticker FROM customer)
    SELECT c_custkey, ticker, max(fetched_at) AS fetched_at FROM c LEFT JOIN (SELECT ticker, fetched_at FROM q WHERE r = 1) USING (ticker) GROUP BY ALL
    """
)
def market_cap_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticker = lambda c: F.concat(F.lit("T"), (F.col(c) % 50).cast("string"))
    cache = table(spark, sf_dir, "orders").select(ticker("o_custkey").alias("ticker"), F.col("o_totalprice").alias("market_cap_cr"), instant("o_orderdate").alias("fetched_at"))
    found = state.lookup_fresh(table(spark, sf_dir, "customer").select("c_custkey", ticker("c_custkey").alias("ticker")), cache, "ticker", at("2001-07-15"), 7)
    return found.select("c_custkey", "ticker", F.col("fetched_at").cast("timestamp_ntz").alias("fetched_at"))


@query(
    """
    WITH f AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS r FROM events)
    SELECT event_type, count(*) AS first_surfaced FROM f WHERE r = 1 GROUP BY 1
    """
)
def first_to_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return dedup.first_of(e, ["user_id", "day"], F.col("ts"), F.col("event_id")).groupBy("event_type").agg(F.count("*").alias("first_surfaced"))


@query(
    """
    WITH iq AS (SELECT DISTINCT 'u' || user_id AS item_id, event_type AS query FROM events),
    m AS (SELECT event_id AS id, user_id % 40 AS deal_id, 'url' || user_id AS url, ts AS attached_at FROM events),
    i AS (SELECT DISTINCT 'u' || user_id AS item_id, 'url' || user_id AS url FROM events),
    t AS (SELECT *, row_number() OVER (PARTITION BY deal_id ORDER BY attached_at, id, item_id) AS r FROM m JOIN i USING (url)),
    s AS (SELECT query, count(*) AS first_surfaced FROM t JOIN iq USING (item_id) WHERE r = 1 GROUP BY 1),
    p AS (SELECT query, count(*) AS produced FROM iq GROUP BY 1)
    SELECT query, coalesce(produced, 0) AS produced, coalesce(first_surfaced, 0) AS first_surfaced FROM p FULL JOIN s USING (query)
    """
)
def query_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, now = table(spark, sf_dir, "events"), at("2024-02-01")
    user = F.col("user_id").cast("string")
    iq = e.select(F.concat(F.lit("u"), user).alias("item_id"), F.col("event_type").alias("query")).distinct().withColumn("created_at", now)
    members = e.select(F.col("event_id").alias("id"), (F.col("user_id") % 40).alias("deal_id"), F.concat(F.lit("url"), user).alias("url"), instant("ts").alias("attached_at"))
    items = e.select(F.concat(F.lit("u"), user).alias("id"), F.concat(F.lit("url"), user).alias("url")).distinct()
    deals = e.select((F.col("user_id") % 40).alias("id")).distinct().withColumn("created_at", now)
    return reports.query_stats(iq, members, items, deals, now)


@query(
    """
    WITH k AS (SELECT p_name || p_brand || p_type AS name, max(p_partkey) AS id, count(*) AS n FROM part GROUP BY 1)
    SELECT name, id FROM k WHERE n = 1
    """
)
def unique_key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "part").groupBy(F.concat("p_name", "p_brand", "p_type").alias("name")).agg(F.max("p_partkey").alias("id"), F.count("*").alias("n"))
    return k.filter("n = 1").select("name", "id")


@query(
    """
    WITH n AS (SELECT * FROM (SELECT lower(c_name) AS name, any_value(c_custkey) AS k, count(*) AS c FROM customer GROUP BY 1) WHERE c = 1),
    m AS (SELECT * FROM (SELECT lower(s_name) AS name, any_value(s_suppkey) AS k, count(*) AS c FROM supplier GROUP BY 1) WHERE c = 1),
    x AS (SELECT c_custkey AS id, c_name AS company FROM customer UNION ALL SELECT -s_suppkey, s_name FROM supplier)
    SELECT id, coalesce(n.k || '.NS', m.k || '.BO') AS ticker FROM x LEFT JOIN n ON n.name = lower(company) LEFT JOIN m ON m.name = lower(company)
    """
)
def ticker_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    nse = sizing.ticker_map(c.select(F.col("c_custkey").cast("string").alias("symbol"), F.col("c_name").alias("name")), "symbol", ".NS")
    bse = sizing.ticker_map(s.select(F.col("s_suppkey").cast("string").alias("code"), F.col("s_name").alias("name")), "code", ".BO")
    asked = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("company")).unionByName(s.select((-F.col("s_suppkey")).alias("id"), F.col("s_name").alias("company")))
    return sizing.resolve_tickers(asked, F.col("company"), nse, bse).select("id", "ticker")


@query("SELECT d.doc_id, source FROM documents d ANTI JOIN labels l ON d.doc_id = l.doc_id")
def seen_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source").withColumns({"fetched_at": F.lit(0), "seq": F.col("doc_id")})
    return dedup.unseen(d, table(spark, sf_dir, "labels").select("doc_id"), "doc_id").select("doc_id", "source")


@query("SELECT * FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def orphan_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("lang = 'en'")
    return state.delete_keys(table(spark, sf_dir, "labels"), d, ["doc_id"])


# ---- state tables


@query(
    """
    WITH old AS (SELECT user_id AS item_id, CASE WHEN bool_or(event_type = 'purchase') THEN 'stage2' ELSE 'stage1' END AS stage, count(*) AS attempts FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1),
    new AS (SELECT user_id AS item_id, CASE WHEN bool_or(event_type = 'purchase') THEN 'stage2' ELSE 'stage1' END AS stage, count(*) AS attempts FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1)
    SELECT CAST(coalesce(o.item_id, n.item_id) AS VARCHAR) AS item_id, CASE WHEN o.stage = 'stage2' OR n.stage = 'stage2' THEN 'stage2' ELSE 'stage1' END AS stage,
           CAST(coalesce(o.attempts, 0) + coalesce(n.attempts, 0) AS INTEGER) AS attempts FROM old o FULL JOIN new n ON o.item_id = n.item_id
    """
)
def upsert_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("item_id"), F.when(F.col("event_type") == "purchase", "stage2").otherwise("stage1").alias("stage"), instant("ts").alias("ts"))
    border = at("2024-01-15")
    first = state.enqueue_retries(schemas.empty(spark, "classify_retry"), e.filter(F.col("ts") < border), border)
    return state.enqueue_retries(first, e.filter(F.col("ts") >= border), at("2024-02-01")).select("item_id", "stage", "attempts")


@query(
    """
    WITH q AS (SELECT CAST(user_id AS VARCHAR) AS item_id, count(*) AS attempts, min(ts) AS first FROM events WHERE event_type = 'purchase' GROUP BY 1),
    i AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS item_id FROM events WHERE event_type = 'click')
    SELECT item_id, 'expired' AS fate FROM q JOIN i USING (item_id) WHERE attempts >= 6 OR first < TIMESTAMP '2024-01-04' - INTERVAL 24 HOURS
    UNION ALL SELECT item_id, 'kept' FROM q JOIN i USING (item_id) WHERE NOT (attempts >= 6 OR first < TIMESTAMP '2024-01-04' - INTERVAL 24 HOURS)
    """
)
def retry_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("item_id", F.col("user_id").cast("string"))
    q = e.filter("event_type = 'purchase'").groupBy("item_id").agg(F.lit("stage1").alias("stage"), F.count("*").cast("int").alias("attempts"), F.min(instant("ts")).alias("first_failed_at"), F.max(instant("ts")).alias("last_attempt_at"))
    expired, left = state.expire_retries(q, e.filter("event_type = 'click'").select(F.col("item_id").alias("id")).distinct(), at("2024-01-04"))
    return expired.select("item_id", F.lit("expired").alias("fate")).unionByName(left.select("item_id", F.lit("kept").alias("fate")))


@query("SELECT ticker, arg_max(v, (ts, event_id)) AS market_cap_cr FROM (SELECT 'T' || user_id AS ticker, value AS v, ts, event_id FROM events) GROUP BY 1")
def replace_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("T"), F.col("user_id").cast("string")).alias("ticker"), F.col("value").alias("market_cap_cr"), F.struct(instant("ts").alias("t"), F.col("event_id")).alias("fetched_at"))
    old, new = e.filter("fetched_at.t < '2024-01-10'"), e.filter("fetched_at.t >= '2024-01-10'")
    return state.replace(old, new, ["ticker"], "fetched_at").drop("fetched_at")


@query("SELECT user_id, event_type, min(ts) AS created_at FROM events GROUP BY ALL HAVING min(ts) >= TIMESTAMP '2024-01-31' - INTERVAL 29 DAYS")
def insert_and_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", instant("ts").alias("created_at"))
    early, late = e.filter("created_at < '2024-01-10'"), e.filter("created_at >= '2024-01-10'")
    once = state.insert_absent(e.limit(0), early, ["user_id", "event_type"], F.col("created_at"))
    kept = state.prune(state.insert_absent(once, late, ["user_id", "event_type"], F.col("created_at")), "created_at", at("2024-01-31"), 29)
    return kept.withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


@query("SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place, count(*) OVER (PARTITION BY o_custkey) AS group_size FROM orders) WHERE place <= 3")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return reports.top_per_group(o, "o_custkey", 3, F.desc("o_totalprice"), F.col("o_orderkey")).drop("hidden")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return dedup.first_of(o, ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice")


# ---- reports


@query(
    """
    WITH r AS (SELECT CASE event_type WHEN 'click' THEN 'Rule 1' WHEN 'purchase' THEN 'Rule 8' ELSE 'Rule ?' END AS rule FROM events)
    SELECT rule, count(*) AS n, CASE rule WHEN 'Rule 1' THEN 'pure debt' WHEN 'Rule 8' THEN 'under 250cr' ELSE 'unclassified' END AS label FROM r GROUP BY rule
    """
)
def suppression_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = F.when(F.col("event_type") == "click", "Rule 1").when(F.col("event_type") == "purchase", "Rule 8").otherwise("Rule ?")
    return reports.suppressed_by_rule(table(spark, sf_dir, "events").select(rule.alias("rule")))


@query("SELECT event_id AS id, value AS amount_cr FROM events ORDER BY value DESC NULLS LAST, event_id LIMIT 1")
def largest_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.largest_suppressed(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("value").alias("amount_cr")))


@query(
    """
    SELECT count(*) AS runs, sum(n)::BIGINT AS fetched, sum(c)::BIGINT AS already_seen, sum(p)::BIGINT AS structural_dropped, 0::BIGINT AS title_deduped, 0::BIGINT AS bse_mcap_gated,
           0::BIGINT AS pre_api_gated, 0::BIGINT AS reached_stage1, 0::BIGINT AS reached_stage2, sum(p)::BIGINT AS alerted
    FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n, count_if(event_type = 'click') AS c, count_if(event_type = 'purchase') AS p FROM events GROUP BY 1)
    """
)
def funnel_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = lambda k: F.count_if(F.col("event_type") == k)
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("fetched"), kind("click").alias("already_seen"), kind("purchase").alias("structural_dropped"), kind("purchase").alias("alerted"))
    return reports.funnel_totals(schemas.conform(days, schemas.STATE["funnel_runs"]))


@query(
    """
    SELECT coalesce(lang, 'unknown') AS value, 'lang' AS field, count(*) AS n FROM labels l LEFT JOIN documents d USING (doc_id) WHERE quality = 0 GROUP BY lang
    UNION ALL SELECT coalesce(source, 'unknown'), 'source', count(*) FROM labels l LEFT JOIN documents d USING (doc_id) WHERE quality = 0 GROUP BY source
    """
)
def feedback_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").filter("quality = 0").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id", "left")
    return reports.breakdowns(rows, ["lang", "source"])


@query(
    """
    SELECT v.verdict, count(l.doc_id) AS n FROM (VALUES ('useful'), ('already_knew'), ('noise')) v(verdict)
    LEFT JOIN labels l ON v.verdict = CASE WHEN quality = 1 THEN 'useful' ELSE 'noise' END GROUP BY 1
    """
)
def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.verdict_counts(spark, table(spark, sf_dir, "labels").select(F.when(F.col("quality") == 1, "useful").otherwise("noise").alias("verdict")))


@query(
    """
    SELECT n_name AS query, coalesce(c, 0) AS produced, coalesce(s, 0) AS first_surfaced FROM nation
    LEFT JOIN (SELECT c_nationkey AS k, count(*) AS c FROM customer GROUP BY 1) a ON a.k = n_nationkey LEFT JOIN (SELECT s_nationkey AS k, count(*) AS s FROM supplier GROUP BY 1) b ON b.k = n_nationkey
    """
)
def stats_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("produced"))
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("first_surfaced"))
    both = c.join(s, "n_nationkey", "full_outer")
    return nation.join(both, "n_nationkey", "left").select(F.col("n_name").alias("query"), F.coalesce("produced", F.lit(0)).alias("produced"), F.coalesce("first_surfaced", F.lit(0)).alias("first_surfaced"))


@query("SELECT o_custkey AS deal_id, c_name AS company, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL HAVING count(*) >= 2")
def clusters_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("deal_id"), F.col("o_orderstatus").alias("title"), F.col("o_orderdate").alias("attached_at"))
    deals = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("company"))
    return reports.merged_clusters(deals, members).drop("titles")


@query(
    """
    WITH s AS (SELECT event_type AS filter, CAST(event_id AS VARCHAR) AS title, ts FROM events UNION ALL SELECT 'title_dedup', 'o' || o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F'),
    r AS (SELECT *, row_number() OVER (PARTITION BY filter ORDER BY ts DESC, title) AS place, count(*) OVER (PARTITION BY filter) AS group_size FROM s)
    SELECT filter, title, place, group_size FROM r WHERE place <= 50
    """
)
def shadow_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("filter"), F.col("event_id").cast("string").alias("title"), F.lit("").alias("url"), F.lit("").alias("reason"), F.col("ts").alias("created_at"))
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("title"), F.lit("").alias("url"), F.lit("").alias("matched_title"), F.lit(1.0).alias("similarity"), F.col("o_orderdate").alias("created_at"))
    return reports.top_per_group(reports.shadow_rows(e, o), "filter", 50, F.desc("created_at"), F.col("title")).select("filter", "title", "place", "group_size")


@query("SELECT l_returnflag AS size_source, count(*) AS n FROM lineitem GROUP BY 1")
def size_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.size_mix(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("size_source")))


# ---- text

TITLE = "trim(regexp_replace(regexp_replace(lower(regexp_replace(trim(title), '\\s+-\\s+[^-]+$', '')), '[^\\pL\\pN_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
STOP = "('promoter','promoters','sells','sell','sold','sale','stake','shares','share','block','bulk','deal','crore','cr','rs','worth','per','cent','buy','buys','acquires','acquired','in','for','to','of','the','a','at','via','after','as','over','likely')"


#: Every line of every text, numbered from zero.
LINES = "h AS (SELECT doc_id, unnest(range(len(l))) AS line, unnest(l) AS title FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))"


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of each text as a headline; seq: texts in order of id, their lines in order."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line", "title"))
    return lines.select((F.col("doc_id") * 2**31 + F.col("line")).cast("long").alias("seq"), "doc_id", F.col("line").cast("long").alias("line"), "title", F.lit("press").alias("source"))


@query(f"WITH {LINES} SELECT doc_id, line, {TITLE} AS title_norm FROM h")
def normalise_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headlines(spark, sf_dir).select("doc_id", "line", text.normalise_title(F.col("title")).alias("title_norm"))


#: Different token sets, and the pairs of them above the threshold.
SETS = f"""
    {LINES}, t AS (SELECT DISTINCT list_sort(list_distinct(list_filter(string_split({TITLE}, ' '), lambda w: w <> '' AND w NOT IN {STOP}))) AS t FROM h),
    s AS (SELECT t, len(t) AS c FROM t WHERE len(t) > 0),
    p AS (SELECT a.t AS a, b.t AS b, len(list_intersect(a.t, b.t)) AS n FROM s a JOIN s b ON b.c > 0.85 * a.c AND b.c < a.c / 0.85 WHERE a.t < b.t),
    r AS (SELECT a, b, n / (len(a) + len(b) - n) AS similarity FROM p WHERE n / (len(a) + len(b) - n) > 0.85)
"""


def _title_sets(spark: SparkSession, sf_dir: str) -> setjoin.SetJoin:
    return setjoin.similar_sets(headlines(spark, sf_dir).select(text.title_tokens(text.normalise_title(F.col("title"))).alias("tokens")), 0.85)


@query(f"WITH {SETS}, e AS (SELECT t, count(*) AS links FROM (SELECT a AS t FROM r UNION ALL SELECT b FROM r) GROUP BY 1) SELECT array_to_string(t, ' ') AS tokens, coalesce(links, 0)::BIGINT AS links FROM s LEFT JOIN e USING (t)")
def title_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each token set of any line, with how many others are similar to it."""
    return setjoin.link_counts(_title_sets(spark, sf_dir)).select(F.translate("name", "\n", " ").alias("tokens"), "links")


@query(f"WITH {SETS} SELECT array_to_string(a, ' ') AS a, array_to_string(b, ' ') AS b, similarity FROM r")
def title_near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of similar token sets themselves."""
    found = _title_sets(spark, sf_dir)
    named = lambda c: found.met.select(F.col("id").alias(c), F.translate("name", "\n", " ").alias(f"t_{c}"))
    pairs = found.links.join(named("a"), "a").join(named("b"), "b")
    # A space sorts before all that tokens hold, so texts are in order as their lists of tokens are.
    return pairs.select(F.least("t_a", "t_b").alias("a"), F.greatest("t_a", "t_b").alias("b"), "similarity")


@query(f"WITH {LINES} SELECT doc_id, line, array_to_string(list_sort(list_distinct(list_filter(string_split({TITLE}, ' '), lambda w: w <> '' AND w NOT IN {STOP}))), ' ') AS tokens FROM h")
def title_near_dup_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token set of each line, as ``title_near_dup`` names it."""
    return headlines(spark, sf_dir).select("doc_id", "line", F.array_join(text.title_tokens(text.normalise_title(F.col("title"))), " ").alias("tokens"))


@query(
    f"""
    WITH {LINES}, t AS (SELECT (doc_id, line) AS seq, {TITLE} AS n FROM h),
    e AS (SELECT seq, n, list_sort(list_distinct(list_filter(string_split(n, ' '), lambda w: w <> '' AND w NOT IN {STOP}))) AS t FROM t WHERE n <> ''),
    u AS (SELECT t, min(seq) AS first FROM e WHERE len(t) > 0 GROUP BY 1),
    s AS (SELECT t, len(t) AS c, first FROM u),
    p AS (SELECT b.t AS b, a.first AS a1, a.c + b.c AS c, len(list_intersect(a.t, b.t)) AS n FROM s a JOIN s b ON b.c > 0.85 * a.c AND b.c < a.c / 0.85 WHERE a.first < b.first),
    x AS (SELECT t, min(first) AS first FROM (SELECT t, first FROM s UNION ALL SELECT b, a1 FROM p WHERE n / (c - n) > 0.85) GROUP BY 1),
    m AS (SELECT n, min(seq) AS first FROM e GROUP BY 1)
    SELECT seq[1] AS doc_id, seq[2] AS line, coalesce(m.first < seq, false) OR coalesce(x.first < seq, false) AS is_duplicate FROM t LEFT JOIN e USING (seq) LEFT JOIN m ON m.n = e.n LEFT JOIN x ON x.t = e.t
    """
)
def title_dedup_shadow(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dataclasses import replace

    from tradesift.config import DEFAULT

    history = spark.createDataFrame([], "title_norm string")
    return dedup.title_duplicates(headlines(spark, sf_dir), history, replace(DEFAULT, enforce=False)).select("doc_id", "line", "is_duplicate")


@query(
    f"""
    WITH RECURSIVE {LINES}, l AS (SELECT doc_id * 2147483648 + line AS seq, {TITLE} AS n FROM h),
    e AS (SELECT seq, n, list_sort(list_distinct(list_filter(string_split(n, ' '), lambda w: w <> '' AND w NOT IN {STOP}))) AS w FROM l WHERE n <> ''),
    c AS (SELECT seq, n, CASE WHEN len(w) > 0 THEN w ELSE ['', n] END AS t, len(w) AS k FROM e),
    heads AS (SELECT t, k, min(seq) AS first, arg_min(n, seq) AS title FROM c GROUP BY t, k),
    p AS (SELECT a.first AS a, b.first AS b, a.k + b.k AS k, len(list_intersect(a.t, b.t)) AS n FROM heads a JOIN heads b ON b.k > 0.85 * a.k AND b.k < a.k / 0.85 WHERE a.first < b.first AND a.k > 0),
    r AS (SELECT a, b, n / (k - n) AS similarity FROM p WHERE n / (k - n) > 0.85),
    turns AS (SELECT b, list(a) AS earlier, row_number() OVER (ORDER BY b) AS turn FROM r GROUP BY b),
    fold(turn, gone) AS (
      SELECT 0::BIGINT, []::BIGINT[]
      UNION ALL SELECT t.turn, CASE WHEN list_has_all(gone, earlier) THEN gone ELSE list_append(gone, b) END FROM fold f JOIN turns t ON t.turn = f.turn + 1),
    gone AS (SELECT unnest(gone) AS first FROM fold WHERE turn = (SELECT max(turn) FROM fold)),
    stay AS (SELECT first, title FROM heads ANTI JOIN gone USING (first)),
    alike AS (SELECT b AS first, a AS other, similarity FROM r UNION ALL SELECT a, b, similarity FROM r UNION ALL SELECT first, first, 1.0 FROM heads),
    m AS (SELECT c.seq, arg_max(struct_pack(t := stay.title, s := similarity), struct_pack(s := similarity, late := -stay.first)) AS best
          FROM c JOIN heads h ON h.t = c.t JOIN alike ON alike.first = h.first JOIN stay ON stay.first = alike.other WHERE stay.first < c.seq GROUP BY 1)
    SELECT (l.seq // 2147483648)::BIGINT AS doc_id, (l.seq % 2147483648)::BIGINT AS line, best IS NOT NULL AS is_duplicate, best.t AS matched_title, best.s AS similarity FROM l LEFT JOIN m USING (seq)
    """
)
def title_dedup_enforce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in order as headlines: one goes if an earlier line that stays is like it. SQL takes them one after another."""
    return dedup.title_duplicates(headlines(spark, sf_dir), spark.createDataFrame([], "title_norm string")).select("doc_id", "line", "is_duplicate", "matched_title", "similarity")


#: Parts of headlines; {n} stands for a number.
MONEY_PARTS = (
    "stake sale worth Rs {n} crore", "block deal of ₹{n}-Crore,", "revenue rose to Rs {n} cr", "promoter offloads {n} lakh shares", "{n} crore Thyrocare equity shares change hands", "assets of {n} lakh crore, valuation",
    "stake bought for $ {n} million", "EUR {n} bn acquisition", "paid Rs.{n},00,000 in a deal", "deal at Rs {n} per share", "Rs {n} lac stake", "{n}cr stake sold - sources", "US$ {n}mn fund raise", "no figure in 2024; 1.{n}.5 crore deal",
    "market cap of INR {n}  crore", "«{n}%» stake, hours {n} lakh units",
)


def _said(orders: DataFrame, between: str) -> DataFrame:
    """o_orderkey, said: three parts, by the key's digits of base 16, with a number each."""
    k, parts = F.col("o_orderkey"), F.array(*map(F.lit, MONEY_PARTS))
    number = lambda i: F.format_number(k * (37 + i) % 9000 + 1, 0)
    part = lambda i: F.replace(F.element_at(parts, (F.floor(k / 16**i) % 16 + 1).cast("int")), F.lit("{n}"), number(i))
    return orders.select("o_orderkey", F.concat_ws(between, part(0), part(1), part(2)).alias("said"))


def _said_sql(between: str) -> str:
    listed = "[" + ", ".join(f"'{p}'" for p in MONEY_PARTS) + "]"
    parts = [f"replace({listed}[(o_orderkey // {16**i}) % 16 + 1], '{{n}}', format('{{:,}}', o_orderkey * {37 + i} % 9000 + 1))" for i in range(3)]
    return f"SELECT o_orderkey, {f" || '{between}' || ".join(parts)} AS said FROM orders"


def _money_sql(t: str) -> str:
    """A list of the figures of ``t``, each reader by itself and without look-around: what may follow is matched, then judged."""
    number = "[0-9][0-9,]*(?:\\.[0-9]+)?"
    noun = "(?:[\\s,-]*(?:[A-Za-z]+[\\s,-]+){0,3}(?:equity\\s+|preference\\s+)?(?:shares?|units?|scrips?)\\b)?"
    value = f"replace(regexp_extract(m, '{number}'), ',', '')::DOUBLE"
    readers = (
        (f"(?:₹|rs\\.?|inr)?\\s*{number}[\\s-]*(?:crore|cr)\\b{noun}", "", value),
        (f"(?:₹|rs\\.?|inr)?\\s*{number}[\\s-]*(?:lakh|lac)s?[\\s-]*(?:crore|cr)\\b{noun}", "", f"{value} * 100000"),
        (f"(?:₹|rs\\.?|inr)?\\s*{number}\\s*(?:lakh|lac)s?\\b(?:[\\s-]*(?:crore|cr)\\b)?{noun}", "AND NOT regexp_matches(m, '(?i)(crore|cr)\\b')", f"{value} / 100"),
        ("(?:₹|rs\\.?|inr)\\s*[0-9][0-9,]{6,}(?:\\.[0-9]+)?(?:\\s*(?:crore|cr|lakh|lac|per))?", f"AND NOT regexp_matches(m, '(?i)[a-z]$') AND length(split_part(replace(regexp_extract(m, '{number}'), ',', ''), '.', 1)) >= 8", f"{value} / 10000000"),
        (f"(?:us\\$|\\$|usd|€|eur)\\s*{number}\\s*(?:billion|bn|million|mn)\\b", "", f"{value} * CASE WHEN regexp_matches(m, '(?i)b(illio)?n$') THEN 1e9 ELSE 1e6 END * CASE WHEN regexp_matches(m, '(?i)^(€|eur)') THEN 96 ELSE 88 END / 10000000"),
    )
    money = "(regexp_matches(m, '(?i)^(₹|rs|inr|us|\\$|€|eur)') OR NOT regexp_matches(m, '(?i)(shares?|units?|scrips?)$'))"
    return "list_concat(" * 4 + ", ".join(f"list_transform(list_filter(regexp_extract_all({t}, '(?i){rx}'), lambda m: {money} {more}), lambda m: {v})" + (")" if i else "") for i, (rx, more, v) in enumerate(readers))


@query(
    f"""
    SELECT o_orderkey, list_max({_money_sql("said")}) AS stated, list_max({_money_sql("said")}) < 250 AS low FROM ({_said_sql(" ")})
    """
)
def amount_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines of several figures in all currencies and notations, share counts and plain numbers among them."""
    said = _said(table(spark, sf_dir, "orders"), " ").select("o_orderkey", text.amounts(F.col("said")).alias("a"))
    return said.select("o_orderkey", "a.stated", (F.col("a.stated") < 250).alias("low"))


_FAR = " " + "~" * 130 + " "
_words = lambda ws: "(?i)\\b(" + "|".join(ws) + ")\\b"


@query(
    f"""
    WITH s AS (SELECT o_orderkey, said FROM ({_said_sql(_FAR)})),
    p AS (SELECT o_orderkey, unnest(string_split(said, '{_FAR}')) AS part FROM s),
    n AS (SELECT o_orderkey, list_max({_money_sql("part")}) AS largest, regexp_matches(part, '{_words(TRANSACTION_WORDS)}') AND NOT regexp_matches(part, '{_words(VALUATION_WORDS)}') AS near FROM p),
    m AS (SELECT o_orderkey, max(largest) AS largest, max(largest) FILTER (near) AS gated FROM n GROUP BY 1)
    SELECT *, coalesce(gated < 250, false) AS fires FROM m
    """
)
def proximity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures far apart: those of deals count, those of revenue and valuations don't."""
    said = _said(table(spark, sf_dir, "orders"), _FAR).select("o_orderkey", "said", text.amounts(F.col("said")).alias("a"))
    return said.select("o_orderkey", F.col("a.stated").alias("largest"), "a.gated", filters.stated_low(F.col("a.gated")).alias("fires"))


@query(
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN NULL ELSE round(l_discount * 100, 2) END AS pct FROM lineitem"
)
def stake_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("promoter sells "), F.round(F.col("l_discount") * 100, 2).cast("string"), F.lit("% stake"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.stake_percent(said).alias("pct"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN x * 10.0 ELSE x END AS amount, o_orderkey % 3 = 0 AS fixed FROM (SELECT o_orderkey, CAST(o_orderkey % 500 + 1 AS DOUBLE) AS x FROM orders)")
def reconcile_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = (F.col("o_orderkey") % 500 + 1).cast("double")
    shown = F.when(F.col("o_orderkey") % 3 == 0, x * 10).otherwise(x).cast("long").cast("string")
    fixed = text.reconcile(x, F.concat(F.lit("₹"), shown, F.lit(" crore")))
    return table(spark, sf_dir, "orders").select("o_orderkey", fixed["amount"].alias("amount"), fixed["fixed"].alias("fixed"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def date_multi_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    raw = F.when(k == 0, F.date_format("o_orderdate", "dd-MMM-yyyy")).when(k == 1, F.date_format("o_orderdate", "d-M-yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(dates.parse_trade_date(raw), "yyyy-MM-dd").alias("day"))


@query("SELECT c_custkey, CASE WHEN c_acctbal = floor(c_acctbal) THEN format('Rs {:,.0f}cr', c_acctbal) ELSE format('Rs {:,.1f}cr', c_acctbal) END AS shown FROM customer")
def money_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", format.amount(F.col("c_acctbal")).alias("shown"))


@query(
    """
    SELECT c_custkey, '🟡 *' || replace(c_name, '_', '\\_') || '* · promoter sale · Rs 300cr' || chr(10) || chr(10) || '_' || c_mktsegment || '_' || chr(10) || chr(10) || '💰 ' || c_name || ' (selling)' || chr(10) || chr(10) || '[x](http://u)' AS text FROM customer
    """
)
def alert_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    a = {"confidence": F.lit("medium"), "company": F.col("c_name"), "is_update": F.lit(False), "deal_type": F.lit("promoter sale"), "amount_cr": F.lit(300.0), "size_source": F.lit("stated"), "size_band": none,
         "one_line": F.col("c_mktsegment"), "individuals": F.array().cast("array<string>"), "seller": F.col("c_name"), "source": F.lit("x"), "url": F.lit("http://u"), "note": none}
    return table(spark, sf_dir, "customer").select("c_custkey", format.alert(a).alias("text"))


@query("SELECT page_id, contains(lower(url), '/liveblog/') OR contains(lower(url), '/slideshow/') OR regexp_matches(lower(url), 'live updates\\s*:') AS noise FROM pages")
def structural_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", filters.structural_noise(F.col("url"), F.col("url"), F.lit("")).alias("noise"))


# ---- feeds


@query(
    """
    WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS href FROM pages)
    SELECT page_id, href, count(*) AS n FROM l GROUP BY ALL
    """
)
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.links(table(spark, sf_dir, "pages")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query("SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total FROM events GROUP BY 1")
def json_extract_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("total"))


def _deal_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    raw = F.struct(
        F.date_format("l_shipdate", "dd-MMM-yyyy").alias("date"), F.concat(F.lit("S"), F.col("l_partkey").cast("string")).alias("symbol"), F.lit("Sec").alias("name"), F.concat(F.lit("Client "), F.col("l_suppkey").cast("string")).alias("clientName"),
        F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("buySell"), F.format_number(F.col("l_quantity") * 10000, 0).alias("qty"), F.format_number("l_extendedprice", 2).alias("watp"),
    )
    json = line.select(F.to_json(F.struct(F.array(raw).alias("BULK_DEALS_DATA"))).alias("j"))
    return json.select(F.from_json("j", schemas.LARGE_DEALS).alias("d")).select("d.*")


@query(
    """
    SELECT 'S' || l_partkey AS symbol, 'Client ' || l_suppkey AS client_name, count(*) AS n, sum(l_quantity * 10000) AS quantity FROM lineitem
    WHERE l_returnflag = 'R' AND l_quantity * l_extendedprice > 0 GROUP BY ALL
    """
)
def large_deal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feeds.large_deals(_deal_json(spark, sf_dir)).filter(filters.is_sell(F.col("buy_sell"), F.col("value_cr")))
    return rows.groupBy("symbol", "client_name").agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"))


@query(
    """
    SELECT 'C' || o_custkey AS symbol, CAST(o_orderkey AS VARCHAR) AS person_name, round_even(o_totalprice / 1e7, 3) AS value_cr FROM orders
    WHERE o_orderstatus = 'F' AND o_totalprice > 0 AND round_even(o_totalprice / 1e7, 3) > 0
    """
)
def disclosure_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    raw = F.to_json(F.struct(F.lit("").alias("date"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("intimDt"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("SYMBOL"), F.col("o_orderkey").cast("string").alias("personName"), F.lit(" Promoter ").alias("category"), F.when(F.col("o_orderstatus") == "F", "Market Sale").otherwise("Buy").alias("acqMode"), F.col("o_totalprice").cast("decimal(20,2)").cast("string").alias("secValue")))
    return sales.selected_disclosures(feeds.disclosures(o.select(raw.alias("value")))).select("symbol", "person_name", "value_cr")


@query("SELECT 'http://x/' || event_id AS id, 'T ' || event_type AS title, 'Google News' AS source, event_type AS source_query FROM events")
def rss_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    entry = F.concat(F.lit("<rss><item><title><![CDATA[T "), F.col("event_type"), F.lit("]]></title><link>http://x/"), F.col("event_id").cast("string"), F.lit("</link></item><item></item></rss>"))
    kinds = ("click", "purchase", "view", "signup", "logout", "login", "error", "search", "refund")
    parts = [feeds.rss(e.filter(F.col("event_type") == k).select(entry.alias("value")), "Google News", k) for k in kinds]
    rest = feeds.rss(e.filter(~F.col("event_type").isin(*kinds)).select(entry.alias("value")), "Google News", "other")
    return feeds.union_all([*parts, rest]).select("id", "title", "source", "source_query")


@query("SELECT event_id AS update_id, CASE WHEN event_id % 3 < 2 THEN CAST(user_id AS VARCHAR) END AS deal_id, CASE event_id % 3 WHEN 0 THEN 'useful' WHEN 1 THEN 'noise' END AS verdict FROM events WHERE event_id > 10")
def callback_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    word = F.when(F.col("event_id") % 3 == 0, "useful").when(F.col("event_id") % 3 == 1, "noise").otherwise("nonsense")
    data = F.concat(F.lit("fb:"), F.col("user_id").cast("string"), F.lit(":"), word)
    updates = e.select(F.col("event_id").alias("update_id"), F.struct(data.alias("data"), F.struct(F.struct(F.lit(1).cast("long").alias("id")).alias("chat")).alias("message")).alias("callback_query"))
    return feeds.callbacks(updates, 10).withColumn("deal_id", F.col("deal_id").cast("string")).drop("chat_id")


# ---- models


@query(
    """
    SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 25 AS batch, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) % 25 AS INTEGER) AS place,
           CASE o_orderkey % 4 WHEN 0 THEN 'suppress' ELSE 'pass' END AS route, CASE o_orderkey % 4 WHEN 0 THEN 'Rule 1' END AS rule FROM orders
    """
)
def stage_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed batches through the stand-in model; answers come back to their places."""
    title = F.when(F.col("o_orderkey") % 4 == 0, "Firm issues debentures").otherwise("Promoter sells stake")
    items = table(spark, sf_dir, "orders").select("o_orderkey", title.alias("title"), F.lit("").alias("description")).withColumn("prompt", classify.prompt(F.col("title"), F.col("description")))
    asked = classify.ask(items, classify.RuleClassifier().stage1, ["o_orderkey"])
    return classify.route_stage1(asked.withColumn("verdict", classify.stage1_verdict(F.col("reply")))).select("o_orderkey", "batch", "place", "route", "rule")


@query(
    """
    SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice / 100 WHEN o_orderkey % 3 = 1 THEN round_even(o_totalprice / 100 * 10 / 100, 1) END AS amount_cr,
      CASE o_orderkey % 3 WHEN 0 THEN 'stated' WHEN 1 THEN 'computed' ELSE 'mcap_plausible' END AS size_source,
      CASE WHEN o_orderkey % 3 = 2 AND o_totalprice / 100 < 350 THEN 'Rule 8' WHEN o_orderkey % 3 = 0 AND o_totalprice / 100 < 250 THEN 'Rule 8' WHEN o_orderkey % 3 = 1 AND round_even(o_totalprice / 100 * 10 / 100, 1) < 250 THEN 'Rule 8' END AS rule
    FROM orders
    """
)
def size_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, cap = F.col("o_orderkey") % 3, F.col("o_totalprice") / 100
    said = F.when(k == 1, "sells 10% stake").otherwise("sells a stake")
    deals = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k == 0, cap).alias("amount_cr"), F.when(k != 0, sizing.computed_size(cap, said)).alias("size"), F.lit("UNKNOWN").alias("size_band"), F.lit("").alias("size_basis"))
    return sizing.size_gates(deals).select("o_orderkey", "amount_cr", "size_source", "rule")


# ---- streams


@query("SELECT event_type AS id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tradesift.streaming import jobs

    e = table(spark, sf_dir, "events")
    source = spark.readStream.schema(e.schema).parquet(*[f"{sf_dir}/events.parquet*"]).select(F.col("event_type").alias("id"), "event_id", "ts")
    out = jobs.scratch(spark, "stream-dedup")
    jobs.dedup_stream(source, "id", ("ts", "event_id"), f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.schema("id string, event_id long, ts timestamp_ntz").parquet(f"{out}/rows").select("id", "event_id")


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-time windows as a stream in complete mode, equal to the batch aggregate."""
    from tradesift.streaming import jobs

    e = table(spark, sf_dir, "events")
    source = spark.readStream.schema(e.schema).parquet(f"{sf_dir}/events.parquet*").withColumn("at", instant("ts"))
    out = jobs.scratch(spark, "stream-windows")
    counted = jobs.windowed_counts(source, "at", "1 hour", "1 day", "event_type", "value")
    counted.writeStream.outputMode("complete").foreachBatch(lambda df, epoch: df.write.mode("overwrite").parquet(f"{out}/rows")).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


# ---- more feeds


#: Fields of filings by key: each is given, empty or missing in turn, so every fallback occurs.
FILED = """
    SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 = 7 THEN NULL ELSE ['Acquisition', 'Board Meeting - Acquisition', '', 'General', 'Pledge'][(o_orderkey % 5 + 1)::INTEGER] END AS category,
           CASE WHEN o_orderkey % 5 = 2 THEN 'Sale of shares' WHEN o_orderkey % 35 = 0 THEN '' WHEN o_orderkey % 35 = 4 THEN NULL ELSE 'News' END AS subject,
           CASE o_orderkey % 4 WHEN 0 THEN 'Head: ' || o_orderkey || ':' WHEN 1 THEN '' WHEN 2 THEN ' ' END AS headline,
           CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'Co' || o_custkey END AS company, CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE '5' || o_custkey END AS code,
           CASE o_orderkey % 3 WHEN 0 THEN 'N' || o_orderkey WHEN 1 THEN '' END AS news_id, CASE o_orderkey % 2 WHEN 0 THEN '2024-01-02T' || o_orderkey ELSE '' END AS stamp,
           CASE o_orderkey % 3 WHEN 1 THEN 'f' || o_orderkey || '.pdf' WHEN 2 THEN '' END AS attached FROM orders
"""


def _one_of(n: int, k: Column, *options: Column | str | None) -> Column:
    """The option that the key's rest by ``n`` picks; null beyond them."""
    out = F.lit(None).cast("string")
    for i, option in enumerate(options):
        out = F.when(k % n == i, F.lit(option) if isinstance(option, str) or option is None else option).otherwise(out)
    return out


@query(
    f"""
    WITH f AS (SELECT *, coalesce(nullif(category, ''), nullif(subject, ''), '') AS c, coalesce(nullif(headline, ''), nullif(subject, ''), '') AS h FROM ({FILED}))
    SELECT 'BSE:' || coalesce(nullif(news_id, ''), nullif(stamp, ''), h) AS id, 'BSE' AS source, trim(coalesce(nullif(company, ''), nullif(code, ''), '') || ': ' || h, ': ') AS title,
           CASE WHEN coalesce(attached, '') = '' THEN 'https://www.bseindia.com/corporates/ann.html' ELSE 'https://www.bseindia.com/xml-data/corpfiling/AttachLive/' || attached END AS url,
           c || '. ' || h AS description, NULL::VARCHAR AS source_query
    FROM f WHERE c IN ('Acquisition', 'Sale of shares', 'Pledge')
    """
)
def bse_filing_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subcategories: a keyword to drop wins over one to keep; an empty subcategory is judged by the subject."""
    k, key, customer = F.col("o_orderkey"), F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    row = F.struct(
        F.when(k % 10 != 7, _one_of(5, k, "Acquisition", "Board Meeting - Acquisition", "", "General", "Pledge")).alias("SUBCATNAME"),
        F.when(k % 5 == 2, "Sale of shares").when(k % 35 == 0, "").when(k % 35 != 4, "News").alias("NEWSSUB"), _one_of(4, k, F.concat(F.lit("Head: "), key, F.lit(":")), "", " ").alias("HEADLINE"),
        _one_of(3, k, "", F.concat(F.lit("Co"), customer)).alias("SLONGNAME"), F.when(k % 7 == 0, "").when(k % 7 != 1, F.concat(F.lit("5"), customer)).alias("SCRIP_CD"),
        _one_of(3, k, F.concat(F.lit("N"), key), "").alias("NEWSID"), _one_of(2, k, F.concat(F.lit("2024-01-02T"), key), "").alias("NEWS_DT"), _one_of(3, k, None, F.concat(F.lit("f"), key, F.lit(".pdf")), "").alias("ATTACHMENTNAME"),
    )
    json = table(spark, sf_dir, "orders").select(F.to_json(F.struct(F.array(row).alias("Table"))).alias("j")).select(F.from_json("j", schemas.FILING).alias("d")).select("d.*")
    return feeds.bse_filings(json)


@query(
    """
    WITH a AS (SELECT CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'S' || o_custkey END AS symbol, CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'Subject: ' || o_orderkey || ' ' END AS subject,
                      CASE o_orderkey % 7 WHEN 0 THEN NULL ELSE repeat('long subject ', (o_orderkey % 30)::INTEGER) || o_orderkey END AS more, CASE o_orderkey % 2 WHEN 0 THEN '' ELSE '1-2-2024' END AS one, strftime(o_orderdate, '%d-%m-%Y') AS other,
                      CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'https://x/' || o_orderkey END AS file FROM orders),
    b AS (SELECT *, coalesce(symbol, '') AS s, coalesce(nullif(subject, ''), more, '') AS t FROM a)
    SELECT substr('NSE:' || s || ':' || coalesce(nullif(one, ''), other) || ':' || t, 1, 200) AS id, 'NSE' AS source, trim(s || ': ' || t, ': ') AS title,
           coalesce(nullif(file, ''), 'https://www.nseindia.com/companies-listing/corporate-filings-announcements') AS url, t AS description, NULL::VARCHAR AS source_query FROM b
    """
)
def nse_announcement_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, key = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    row = F.struct(
        F.when(k % 5 == 0, "").when(k % 5 != 1, F.concat(F.lit("S"), F.col("o_custkey").cast("string"))).alias("symbol"), _one_of(3, k, "", F.concat(F.lit("Subject: "), key, F.lit(" "))).alias("subject"),
        F.when(k % 7 != 0, F.concat(F.repeat(F.lit("long subject "), (k % 30).cast("int")), key)).alias("desc"), _one_of(2, k, "", "1-2-2024").alias("an_dt"), F.date_format("o_orderdate", "dd-MM-yyyy").alias("dt"),
        _one_of(4, k, "", F.concat(F.lit("https://x/"), key)).alias("attchmntFile"),
    )
    json = table(spark, sf_dir, "orders").select(F.to_json(row).alias("j"))
    return feeds.nse_announcements(json.select(F.from_json("j", schemas.ANNOUNCEMENT).alias("d")).select("d.*"))


@query(
    """
    WITH s AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'https://www.sebi.gov.in/filings/' || o_orderkey WHEN 1 THEN 'http://x/drhp/' || o_orderkey ELSE 'https://www.sebi.gov.inprospectus?a=1&b=' || o_orderkey END AS url,
                      CASE o_orderkey % 3 WHEN 0 THEN 'Draftoffer' || o_orderkey WHEN 1 THEN 'Paper  "' || o_orderkey || '" & more' ELSE 'No. ' || o_orderkey END AS title FROM orders)
    SELECT 'SEBI:' || url AS id, 'SEBI' AS source, title, url, 'SEBI draft offer document: ' || title AS description, NULL::VARCHAR AS source_query FROM s
    """
)
def sebi_listing_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three links a page: one of a keyword in its text or target, with tags, comments and entities; one without, one
    without text."""
    k, key = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    link = _one_of(
        3, k, F.concat(F.lit("<a class='x' href='/filings/"), key, F.lit("'>Draft <b>offer</b>\n <!-- a > b --> "), key, F.lit("&nbsp;</a>")),
        F.concat(F.lit('<a href="http://x/drhp/'), key, F.lit('">Paper  &quot;'), key, F.lit("&quot; &amp; more</a>")), F.concat(F.lit('<a href="prospectus?a=1&amp;b='), key, F.lit('"> No. '), key, F.lit("\t</a>")),
    )
    page = F.concat(F.lit("<p>"), link, F.lit('<a href="/about">About</a> <a href="/drhp/none"> <i> </i></a></p>'))
    return feeds.sebi_listing(table(spark, sf_dir, "orders").select(page.alias("html")))


# ---- more state and joins


def _queue(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A retry queue of event users and the items of those who bought."""
    e = table(spark, sf_dir, "events").withColumn("item_id", F.col("user_id").cast("string"))
    queue = e.groupBy("item_id").agg(F.when(F.max("event_id") % 2 == 0, "stage2").otherwise("stage1").alias("stage"), F.lit(1).alias("attempts"), F.min(instant("ts")).alias("first_failed_at"))
    return queue, e.filter("event_type = 'purchase'").groupBy(F.col("item_id").alias("id")).agg(F.max("value").alias("value"))


@query(
    """
    WITH q AS (SELECT CAST(user_id AS VARCHAR) AS item_id, max(event_id) AS m FROM events GROUP BY 1), i AS (SELECT CAST(user_id AS VARCHAR) AS item_id, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1)
    SELECT item_id, value FROM q JOIN i USING (item_id) WHERE m % 2 = 0
    """
)
def pending_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue, items = _queue(spark, sf_dir)
    return state.pending_retries(queue, items, "stage2").select("item_id", "value")


@query(
    """
    SELECT event_id AS id, user_id AS deal_id, event_type AS verdict, c_name AS company FROM events LEFT JOIN customer ON c_custkey = user_id
    WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 14 DAYS
    """
)
def feedback_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback of the last two weeks with its deals."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("deal_id"), F.col("event_type").alias("verdict"), instant("ts").alias("created_at"))
    deals = schemas.conform(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("company")), schemas.STATE["deals"])
    return reports.feedback_rows(e, deals, at("2024-01-30")).select("id", "deal_id", "verdict", "company")


@query(
    """
    SELECT CASE o_custkey % 4 WHEN 0 THEN 'Ravi Kumar ' WHEN 2 THEN 'Acme Family Holdings Ltd ' END || o_custkey AS client_name, CASE o_custkey % 4 WHEN 0 THEN 'individual' ELSE 'ambiguous' END AS seller_class,
           CASE o_custkey % 4 WHEN 0 THEN 'unclear' ELSE 'promoter' END AS seller_verdict, count(*) AS n
    FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 4 IN (0, 2) GROUP BY ALL
    """
)
def seller_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales by individuals and promoter vehicles: institutions go by keyword or, where the name is ambiguous, by the model."""
    kind = F.element_at(F.array(*map(F.lit, ("Ravi Kumar ", "SBI Mutual Fund ", "Acme Family Holdings Ltd ", "Global Equity "))), (F.col("o_custkey") % 4 + 1).cast("int"))
    trades = table(spark, sf_dir, "orders").select(F.concat(kind, F.col("o_custkey").cast("string")).alias("client_name"), F.when(F.col("o_orderstatus") == "F", "SELL").otherwise("BUY").alias("buy_sell"), F.col("o_totalprice").alias("value_cr"))
    return sales.selected_trades(trades).groupBy("client_name", "seller_class", "seller_verdict").agg(F.count("*").alias("n"))


@query(
    """
    WITH d AS (SELECT o_custkey AS id, max(o_totalprice) AS a FROM orders WHERE o_custkey % 3 = 0 GROUP BY 1)
    SELECT c_custkey AS id, CASE WHEN d.a > 300000 THEN d.a ELSE c_acctbal END AS amount_cr, c_name AS seller, d.id IS NOT NULL AS touched FROM customer LEFT JOIN d ON d.id = c_custkey
    """
)
def partial_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that the delta leaves null stay; rows it has are touched."""
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("amount_cr"), F.col("c_name").alias("seller"), at("2024-01-01").alias("updated_at"))
    largest = table(spark, sf_dir, "orders").filter("o_custkey % 3 = 0").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_totalprice").alias("a"))
    delta = largest.select("id", F.when(F.col("a") > 300000, F.col("a")).alias("amount_cr"), F.lit(None).cast("string").alias("seller"))
    new = state.update_columns(old, delta, "id", ["amount_cr", "seller"], at("2024-02-01"))
    return new.select("id", "amount_cr", "seller", (F.col("updated_at") == at("2024-02-01")).alias("touched"))


@query(
    """
    WITH m AS (SELECT max(c_custkey) AS top FROM customer)
    SELECT s_name AS company, top + row_number() OVER (ORDER BY s_suppkey) AS id FROM supplier, m
    """
)
def new_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of new deals follow the state's, densely and in order."""
    deals = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return state.with_ids(deals, table(spark, sf_dir, "supplier").select(F.col("s_name").alias("company"), "s_suppkey"), "s_suppkey").select("company", F.col("id").cast("long").alias("id"))


@query(
    """
    WITH t AS (SELECT DISTINCT 'NSE:block deal:' || strftime(l_shipdate, '%Y-%m-%d') || ':S' || l_partkey || ':C' || l_suppkey || ':SELL:' || l_quantity AS id, l_orderkey FROM lineitem),
    s AS (SELECT id FROM t WHERE l_orderkey % 2 = 0)
    SELECT DISTINCT id FROM t WHERE id NOT IN (SELECT id FROM s)
    """
)
def trade_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades by their compound id, once each, that the state has not seen."""
    t = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.lit("NSE").alias("exchange"), F.lit("block deal").alias("deal_type"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("trade_date"), F.concat(F.lit("S"), F.col("l_partkey").cast("string")).alias("symbol"),
        F.concat(F.lit("C"), F.col("l_suppkey").cast("string")).alias("client_name"), F.lit("SELL").alias("buy_sell"), F.col("l_quantity").alias("quantity"),
    ).withColumn("id", sales.trade_id()).withColumns({"fetched_at": F.lit(0), "seq": F.col("l_orderkey")})
    return dedup.unseen(t, t.filter("l_orderkey % 2 = 0").select("id")).select("id")


@query(
    """
    WITH r AS (SELECT o_custkey, min(o_orderkey) AS seq, arg_min(o_totalprice, o_orderkey) / 10 AS a FROM orders GROUP BY 1),
    f AS (SELECT seq, c_custkey, c_acctbal AS b, a, (b = 0 OR (b > 0 AND abs(a - b) / b > 0.2)) AS fires FROM r JOIN customer ON c_custkey = o_custkey)
    SELECT seq, 'd' || c_custkey AS deal_ref, false AS is_new, fires, CASE WHEN NOT fires THEN '' WHEN b = 0 THEN 'amount added' ELSE 'amount revised ' || printf('%g', b) || '→' || printf('%g', a) || ' cr' END AS note,
           CASE WHEN fires THEN a ELSE b END AS amount_cr FROM f
    """
)
def deal_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One repeat report for each open deal: it fires if the amount is new or moves by more than a fifth."""
    name = lambda c: F.concat(F.lit("acme"), F.col(c).cast("string"))
    deals = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), name("c_custkey").alias("company"), F.col("c_acctbal").alias("amount_cr"), at("2024-01-01").alias("created_at"), F.lit(False).alias("confirmed"), F.array().cast("array<string>").alias("individuals"))
    first = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(F.struct("o_orderkey", "o_totalprice")).alias("o"))
    seen = first.select(F.col("o.o_orderkey").alias("seq"), name("o_custkey").alias("company"), (F.col("o.o_totalprice") / 10).alias("amount_cr"), at("2024-01-01 05:00:00").alias("at"), F.lit(False).alias("confirmed"), F.array().cast("array<string>").alias("individuals"))
    found = cluster.cluster(schemas.conform(seen, cluster.REPORT), schemas.conform(deals, schemas.STATE["deals"]))
    return found.select("seq", "deal_ref", "is_new", "fires", "note", "amount_cr")


# ---- more gates, models and reports


@query(
    """
    WITH c AS (SELECT c_name, c_custkey, lower(c_name) AS k, c_acctbal * 0.5 AS cap FROM customer)
    SELECT c_custkey, round_even(cap, 1) AS market_cap_cr, c_custkey % 2 = 0 AND round_even(cap, 1) < 1000 AS small FROM c
    """
)
def filing_mcap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings of companies known to be small: name before the colon, ticker, quoted cap, gate."""
    c = table(spark, sf_dir, "customer").withColumn("source", F.when(F.col("c_custkey") % 2 == 0, "BSE").otherwise("NSE")).withColumn("title", F.concat("c_name", F.lit(": sale of stake")))
    master = sizing.ticker_map(c.select(F.col("c_custkey").cast("string").alias("code"), F.col("c_name").alias("name")), "code", ".BO")
    none = spark.createDataFrame([], "name_key string, ticker string")
    quotes = c.select(F.concat(F.col("c_custkey").cast("string"), F.lit(".BO")).alias("ticker"), (F.col("c_acctbal") * 0.5).alias("market_cap_cr"))
    capped = sizing.market_caps(sizing.resolve_tickers(c, F.split_part("title", F.lit(":"), F.lit(1)), none, master), schemas.empty(spark, "market_caps"), at("2024-01-01"), quotes)
    return capped.select("c_custkey", "market_cap_cr", filters.filing_mcap_gate(F.col("source"), F.col("market_cap_cr")).alias("small"))


@query(
    """
    SELECT 'structural' AS filter, 'T' || event_id AS title, 'reason ' || event_type AS reason FROM events WHERE event_type = 'click'
    """
)
def shadow_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a gate in shadow mode logs; everything goes on."""
    from dataclasses import replace

    from tradesift.config import DEFAULT

    e = table(spark, sf_dir, "events").select(F.concat(F.lit("T"), F.col("event_id").cast("string")).alias("title"), F.lit("").alias("url"), "event_type", (F.col("event_type") == "click").alias("fires"))
    _, log = filters.apply_gate(e, "fires", "structural", F.concat(F.lit("reason "), F.col("event_type")), at("2024-01-01"), replace(DEFAULT, enforce=False))
    return log.select("filter", "title", "reason")


@query(
    """
    SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'retry' WHEN 1 THEN 'suppress' ELSE 'pass' END AS route, CASE o_orderkey % 4 WHEN 1 THEN 'Rule P' END AS rule,
           CASE WHEN o_orderkey % 4 = 2 THEN 'block deal' ELSE 'unknown' END AS deal_type, 'medium' AS confidence, 'UNKNOWN' AS size_band, 'no information' AS size_basis,
           CASE o_orderkey % 4 WHEN 2 THEN CAST(o_orderkey % 500 + 1 AS DOUBLE) * 10 WHEN 3 THEN CAST(o_orderkey % 500 + 1 AS DOUBLE) END AS amount_cr FROM orders
    """
)
def stage2_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second-stage answers: defaults for what is missing, a tenfold slip repaired from the quoted figure, failures apart."""
    k = F.col("o_orderkey")
    n = (k % 500 + 1).cast("double")
    quoted = F.concat(F.lit("₹"), (n * 10).cast("long").cast("string"), F.lit(" crore"))
    reply = (
        F.when(k % 4 == 1, F.to_json(F.struct(F.lit(False).alias("qualify"))))
        .when(k % 4 == 2, F.to_json(F.struct(F.lit(True).alias("qualify"), F.lit("block deal").alias("deal_type"), n.alias("amount_cr"), quoted.alias("amount_raw"), F.lit("").alias("confidence"))))
        .when(k % 4 == 3, F.to_json(F.struct(F.lit(True).alias("qualify"), F.lit("").alias("deal_type"), n.alias("amount_cr"))))
    )
    asked = table(spark, sf_dir, "orders").select("o_orderkey", reply.alias("reply"), (k % 4 == 0).alias("failed"))
    routed = classify.route_stage2(asked.withColumn("result", classify.stage2_result(F.col("reply"))))
    return routed.select("o_orderkey", "route", "rule", *[f"result.{c}" for c in ("deal_type", "confidence", "size_band", "size_basis", "amount_cr")])


@query(
    """
    SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 'Rule S' END AS rule, CASE WHEN o_orderkey % 3 = 1 THEN 'band' ELSE 'unknown' END AS size_source FROM orders
    """
)
def band_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A guess of a small size counts only if it has a basis."""
    k = F.col("o_orderkey")
    band = F.when(k % 3 == 0, "UNDER_100").when(k % 3 == 1, "100_TO_500").otherwise("UNKNOWN")
    none = F.lit(None).cast("struct<computed_cr:double,mcap_cr:double>")
    deals = table(spark, sf_dir, "orders").select("o_orderkey", F.lit(None).cast("double").alias("amount_cr"), none.alias("size"), band.alias("size_band"), F.when(k % 2 == 0, "headline").otherwise(" No information ").alias("size_basis"))
    return sizing.size_gates(deals).select("o_orderkey", "rule", "size_source")


@query("SELECT o_orderkey, printf('%g', o_totalprice / (o_orderkey % 7 + 1)) AS shown FROM orders")
def general_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", format.general(F.col("o_totalprice") / (F.col("o_orderkey") % 7 + 1)).alias("shown"))


@query(
    """
    SELECT l_orderkey, l_linenumber, '🟢 CONFIRMED' || CASE WHEN l_linenumber > 1 THEN ' UPDATE' ELSE '' END || ' · *Acme Steel* · block deal · ' || format('Rs {:,.0f}cr', l_linenumber * 250.0) || chr(10) || chr(10) || 'Client\\_' || l_suppkey || ' sold '
           || format('{:,.0f}', l_quantity) || ' shares at Rs ' || printf('%g', l_linenumber * 2.5) || chr(10) || chr(10) || 'Settles T+1 · trade date ' || strftime(l_shipdate, '%Y-%m-%d') || chr(10) || 'NSE daily deal file' AS text FROM lineitem
    """
)
def confirmed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    row = {"is_update": n > 1, "security_name": F.lit("Acme Steel"), "deal_type": F.lit(""), "value_cr": n * 250.0, "client_name": F.concat(F.lit("Client_"), F.col("l_suppkey").cast("string")), "quantity": F.col("l_quantity"), "price": n * 2.5,
           "trade_date": F.date_format("l_shipdate", "yyyy-MM-dd"), "exchange": F.lit("NSE")}
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", format.confirmed_alert(row).alias("text"))


@query(
    """
    WITH o AS (SELECT o_custkey % 100 AS person, list(struct_pack(d := strftime(o_orderdate, '%Y-%m-%d'), v := floor(o_totalprice)) ORDER BY o_orderdate, o_orderkey) AS s, sum(floor(o_totalprice)) AS total,
                      greatest(1, round_even(date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE) / 7, 0)::INTEGER) AS weeks FROM orders GROUP BY 1)
    SELECT person, '🟣 PATTERN · *P\\_' || person || '* · Acme · ' || format('Rs {:,.0f}cr', total) || ' over ' || len(s) || ' sales' || chr(10) || chr(10)
      || CASE WHEN len(s) > 20 THEN '… ' || (len(s) - 20) || ' earlier sales totalling ' || format('Rs {:,.0f}cr', list_sum(list_transform(s[:len(s) - 20], lambda x: x.v))) || ' …' || chr(10) ELSE '' END
      || array_to_string(list_transform(s[greatest(len(s) - 19, 1):], lambda x: x.d || '  ' || format('Rs {:,.0f}cr', x.v)), chr(10)) || chr(10) || chr(10) || weeks || ' weeks · no single sale crossed the threshold' AS text FROM o
    """
)
def pattern_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last twenty sales are listed, earlier ones summed."""
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("person"), F.struct("o_orderdate", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("trade_date"), F.floor("o_totalprice").cast("double").alias("value_cr")).alias("s"))
    g = o.groupBy("person").agg(F.array_sort(F.collect_list("s")).alias("s"), F.sum("s.value_cr").alias("total"))
    weeks = dates.span_weeks(F.transform("s", lambda x: dates.parse_trade_date(x["trade_date"])))
    return g.select("person", format.pattern_alert(F.concat(F.lit("P_"), F.col("person").cast("string")), F.lit("Acme"), F.col("total"), F.col("s"), weeks).alias("text"))


@query(
    """
    WITH s AS (SELECT event_id AS id, 'T' || event_id AS title, CASE event_type WHEN 'click' THEN 'pure debt' WHEN 'purchase' THEN 'under 250cr' ELSE 'other' END AS label, value FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 24 HOURS)
    SELECT 'suppressed' AS section, label AS name, count(*) AS n, NULL::DOUBLE AS amount FROM s GROUP BY label
    UNION ALL SELECT 'largest', arg_max(title, (value, -id)), 1, max(value) FROM s
    UNION ALL SELECT 'confirmed', 'deals', count(*), NULL FROM customer WHERE c_custkey % 3 = 0
    UNION ALL SELECT 'pattern', 'alerts', count(*), NULL FROM orders WHERE o_orderdate >= TIMESTAMP '2024-01-20' - INTERVAL 24 HOURS
    UNION ALL SELECT 'funnel', unnest(['runs', 'fetched', 'already_seen', 'structural_dropped', 'title_deduped', 'bse_mcap_gated', 'pre_api_gated', 'reached_stage1', 'reached_stage2', 'alerted']), unnest([1, 7, 0, 0, 0, 0, 0, 0, 0, 2]), NULL
    """
)
def daily_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sections of a day's digest."""
    e = table(spark, sf_dir, "events")
    rule = F.when(F.col("event_type") == "click", "Rule 1").when(F.col("event_type") == "purchase", "Rule 8").otherwise("unheard of")
    suppressed = e.select(F.col("event_id").alias("id"), F.concat(F.lit("T"), F.col("event_id").cast("string")).alias("title"), rule.alias("rule"), F.col("value").alias("amount_cr"), instant("ts").alias("created_at"))
    deals = table(spark, sf_dir, "customer").select(at("2024-01-20").alias("updated_at"), (F.col("c_custkey") % 3 == 0).alias("confirmed"))
    alerts = table(spark, sf_dir, "orders").select(instant("o_orderdate").alias("alerted_at"))
    runs = schemas.conform(spark.range(1).select(F.lit(7).alias("fetched"), F.lit(2).alias("alerted"), at("2024-01-20").alias("created_at")), schemas.STATE["funnel_runs"])
    return reports.digest(spark, suppressed, deals, alerts, runs, at("2024-01-20"))


@query(
    """
    WITH s AS (SELECT event_type AS query, count(*) AS n FROM events GROUP BY 1)
    SELECT q.query, coalesce(n, 0) AS produced, coalesce(2 * n, 0) AS first_surfaced FROM (VALUES ('click'), ('nothing'), ('view')) q(query) LEFT JOIN s USING (query)
    """
)
def configured_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every configured query has a row, whether it brought anything or not."""
    stats = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("query")).agg(F.count("*").alias("produced")).withColumn("first_surfaced", 2 * F.col("produced"))
    return reports.configured_query_stats(spark, ("click", "nothing", "view"), stats)
