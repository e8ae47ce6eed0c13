"""Landed feeds as DataFrames of the common shape. Network fetchers stay outside: they land files, these readers parse
them. Malformed parts become empty rows' absence, never an error."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradesift import schemas
from tradesift.config import LISTING_KEYWORDS, NEWS_QUERIES, PIT_FIELDS
from tradesift.functions import dates
from tradesift.functions.text import number
from tradesift.operators import filters


def _text(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _item(df: DataFrame, id_: Column, source: str, title: Column, url: Column, description: Column, query: str | None = None) -> DataFrame:
    none = F.lit("")
    return df.select(F.coalesce(id_, none).alias("id"), F.lit(source).alias("source"), F.coalesce(title, none).alias("title"), F.coalesce(url, none).alias("url"), F.coalesce(description, none).alias("description"), F.lit(query).cast("string").alias("source_query"))


def rss(pages: DataFrame, source: str, query: str | None = None) -> DataFrame:
    """``pages``: value, one RSS or Atom document each. Entries without link and title are skipped; the link, or else the
    title, is the id. Entries are cut out by pattern, so a broken tail does not lose what stands before it."""
    entry = F.explode(F.regexp_extract_all("value", F.lit(r"(?is)<(?:item|entry)\b[^>]*>(.*?)</(?:item|entry)>"), F.lit(1))).alias("e")
    tag = lambda name: _text(_unescape(F.regexp_replace(F.regexp_extract("e", rf"(?is)<{name}\b[^>]*>(.*?)</{name}>", 1), r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1")))
    link = F.coalesce(tag("link"), _text(F.regexp_extract("e", r"(?is)<link\b[^>]*href=[\"']([^\"']+)", 1)))
    title = tag("title")
    cut = pages.select(entry).select(link.alias("link"), title.alias("t"), F.coalesce(tag("summary"), tag("description")).alias("d"))
    return _item(cut.filter("link IS NOT NULL OR t IS NOT NULL"), F.coalesce("link", "t"), source, F.col("t"), F.col("link"), F.col("d"), query)


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def news(read: Callable[[str], DataFrame], queries: tuple[str, ...] = NEWS_QUERIES) -> DataFrame:
    """One feed for each query; the item keeps which query brought it."""
    return union_all([rss(read(q), "Google News", q) for q in queries])


def _given(*options: Column) -> Column:
    """The first that is neither null nor empty, or the empty string. Blanks count as given."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in options], F.lit(""))


def _headed(name: Column, line: Column) -> Column:
    return F.regexp_replace(F.concat(name, F.lit(": "), line), "^[: ]+|[: ]+$", "")


#: Where a filing or announcement without a document of its own is found.
FILING_FOLDER, FILING_PAGE = "https://www.bseindia.com/xml-data/corpfiling/AttachLive/", "https://www.bseindia.com/corporates/ann.html"
ANNOUNCEMENT_PAGE = "https://www.nseindia.com/companies-listing/corporate-filings-announcements"


def bse_filings(json: DataFrame) -> DataFrame:
    """``json``: of schemas.FILING. Without an id of its own a filing goes by its time, or else its headline."""
    r = json.select(F.explode("Table").alias("r")).select("r.*")
    c = {n: F.col(n) for n in ("SUBCATNAME", "NEWSSUB", "HEADLINE", "SLONGNAME", "SCRIP_CD", "NEWSID", "NEWS_DT", "ATTACHMENTNAME")}
    category, headline = _given(c["SUBCATNAME"], c["NEWSSUB"]), _given(c["HEADLINE"], c["NEWSSUB"])
    attached = _given(c["ATTACHMENTNAME"])
    url = F.when(attached != "", F.concat(F.lit(FILING_FOLDER), attached)).otherwise(FILING_PAGE)
    id_ = F.concat(F.lit("BSE:"), _given(c["NEWSID"], c["NEWS_DT"], headline))
    return _item(r.filter(filters.filing_kept(category)), id_, "BSE", _headed(_given(c["SLONGNAME"], c["SCRIP_CD"]), headline), url, F.concat(category, F.lit(". "), headline))


def nse_announcements(rows: DataFrame) -> DataFrame:
    """``rows``: of schemas.ANNOUNCEMENT."""
    subject, symbol = _given(F.col("subject"), F.col("desc")), _given(F.col("symbol"))
    id_ = F.substring(F.concat_ws(":", F.lit("NSE"), symbol, _given(F.col("an_dt"), F.col("dt")), subject), 1, 200)
    return _item(rows, id_, "NSE", _headed(symbol, subject), _given(F.col("attchmntFile"), F.lit(ANNOUNCEMENT_PAGE)), subject)


def _unescape(c: Column) -> Column:
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\xa0"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(mark))
    return c


def _anchors(pages: DataFrame, html: str) -> DataFrame:
    """All columns with href and inner (markup) of every anchor."""
    rx = r"(?is)<a\b[^>]*?href=[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"
    both = F.arrays_zip(F.regexp_extract_all(html, F.lit(rx), F.lit(1)).alias("href"), F.regexp_extract_all(html, F.lit(rx), F.lit(2)).alias("inner"))
    return pages.withColumn("_l", F.explode(both)).select(*pages.columns, F.col("_l.href").alias("href"), F.col("_l.inner").alias("inner"))


def links(pages: DataFrame, html: str = "html") -> DataFrame:
    """All columns with href and text of every anchor."""
    return _anchors(pages, html).withColumn("text", F.trim(F.regexp_replace(F.regexp_replace("inner", "<[^>]*>", " "), r"\s+", " "))).drop("inner")


def sebi_listing(pages: DataFrame, base: str = "https://www.sebi.gov.in") -> DataFrame:
    """Links whose text or target has one of the listing keywords. A link's text is that of its pieces between tags, each
    without the white space around it, one after another."""
    pieces = F.transform(F.split("inner", r"(?s)<!--.*?-->|<[^>]*>", -1), lambda t: F.regexp_replace(_unescape(t), r"(?U)^\s+|\s+$", ""))
    found = _anchors(pages, "html").select(_unescape(F.col("href")).alias("href"), F.array_join(pieces, "").alias("text"))
    found = found.filter("text <> ''").filter(F.lower(F.concat_ws(" ", "text", "href")).rlike("|".join(LISTING_KEYWORDS)))
    url = F.when(F.col("href").startswith("http"), F.col("href")).otherwise(F.concat(F.lit(base), F.col("href")))
    return _item(found, F.concat(F.lit("SEBI:"), url), "SEBI", F.col("text"), url, F.concat(F.lit("SEBI draft offer document: "), F.col("text")))


def large_deals(json: DataFrame, exchange: str = "NSE") -> DataFrame:
    """``json``: of schemas.LARGE_DEALS. Rows need symbol, client and side; a missing or zero factor leaves no value, one that
    is no number the whole row out."""
    sides = [json.select(F.explode(c).alias("r")).select("r.*").withColumn("deal_type", F.lit(t)) for c, t in (("BULK_DEALS_DATA", "bulk deal"), ("BLOCK_DEALS_DATA", "block deal"))]
    r = sides[0].unionByName(sides[1])
    quantity, price = number(F.col("qty")), number(F.col("watp"))
    value = F.bround(F.nullif(quantity, F.lit(0.0)) * F.nullif(price, F.lit(0.0)) / 1e7, 2)
    sound = (F.col("qty").isNull() | quantity.isNotNull()) & (F.col("watp").isNull() | price.isNotNull())
    symbol = _given(F.col("symbol"))
    kept = r.filter((symbol != "") & _text(F.col("clientName")).isNotNull() & _text(F.col("buySell")).isNotNull() & sound)
    return kept.select(
        _given(F.col("date")).alias("trade_date"), symbol.alias("symbol"), _given(F.col("name"), symbol).alias("security_name"), F.trim("clientName").alias("client_name"),
        F.upper(F.trim("buySell")).alias("buy_sell"), quantity.alias("quantity"), price.alias("price"), value.alias("value_cr"), F.lit(exchange).alias("exchange"), "deal_type",
    )


def bse_large_deals(spark: SparkSession) -> DataFrame:
    """The exchange publishes no such feed: empty, with the schema."""
    return spark.createDataFrame([], schemas.TRADE)


def disclosures(rows: DataFrame, column: str = "value") -> DataFrame:
    """Schemaless JSON objects, one per row: each field is the first non-empty of its candidate keys."""
    field = lambda name: F.coalesce(*[_text(F.try_element_at("v", F.lit(k))) for k in PIT_FIELDS[name]])
    got = rows.select(F.from_json(column, "map<string,string>").alias("v")).select(*[field(f).alias(f) for f in PIT_FIELDS])
    kept = got.filter("symbol IS NOT NULL AND person_name IS NOT NULL")
    return kept.select("trade_date", "symbol", F.coalesce("company", "symbol").alias("company"), "person_name", F.lower("category").alias("category"), F.lower("trans_type").alias("trans_type"), F.bround(number(F.col("value")) / 1e7, 3).alias("value_cr"))


def read_disclosures(spark: SparkSession, path: str, first: date, last: date) -> DataFrame:
    """Landed disclosures (JSON lines) of trades from ``first`` to ``last``. Days that cannot be read stay."""
    rows = disclosures(spark.read.text(path))
    day = dates.parse_trade_date(F.col("trade_date"))
    return rows.filter(day.isNull() | day.between(F.lit(first), F.lit(last)))


def press(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """All press feeds as one: ``folders`` maps a feed's name to where its documents have landed, one a file. Items carry
    the feed's name as source."""
    return union_all([rss(spark.read.text(path, wholetext=True), name) for name, path in folders.items()])


def landed(spark: SparkSession, base: str, press_feeds: tuple[str, ...], queries: tuple[str, ...] = NEWS_QUERIES) -> dict[str, Callable[[], DataFrame]]:
    """Readers of what fetchers have landed under ``base``: news/<number of the query>, press/<feed>, sebi (documents, one a
    file), bse and nse (JSON, one a line)."""
    documents = lambda path: spark.read.text(f"{base}/{path}", wholetext=True)
    return {
        "news": lambda: news(lambda q: documents(f"news/{queries.index(q)}"), queries),
        "press": lambda: press(spark, {f: f"{base}/press/{f}" for f in press_feeds}),
        "bse": lambda: bse_filings(spark.read.schema(schemas.FILING).json(f"{base}/bse")),
        "nse": lambda: nse_announcements(spark.read.schema(schemas.ANNOUNCEMENT).json(f"{base}/nse")),
        "sebi": lambda: sebi_listing(documents("sebi").withColumnRenamed("value", "html")),
    }


def read_master(spark: SparkSession, path: str, id_col: str) -> DataFrame:
    """A ticker master CSV with a header: the id column and name."""
    return spark.read.schema(f"{id_col} string, name string").option("header", True).csv(path)


def refresh_master(raw: DataFrame, id_from: str, name_from: str, id_col: str, path: str) -> None:
    """Project, trim and store a downloaded list; incomplete rows go."""
    out = raw.select(_text(F.col(id_from)).alias(id_col), _text(F.col(name_from)).alias("name")).dropna()
    out.write.mode("overwrite").option("header", True).csv(path)


def callbacks(updates: DataFrame, offset: int = 0) -> DataFrame:
    """Button presses after ``offset``: update_id, chat_id, deal_id, verdict; malformed data has null deal and verdict."""
    data = F.coalesce(F.col("callback_query.data"), F.lit(""))
    rx = r"^fb:([0-9]+):(useful|already_knew|noise)$"
    return updates.filter(F.col("update_id") > offset).select(
        "update_id", F.col("callback_query.message.chat.id").cast("string").alias("chat_id"), F.nullif(F.regexp_extract(data, rx, 1), F.lit("")).cast("long").alias("deal_id"), F.nullif(F.regexp_extract(data, rx, 2), F.lit("")).alias("verdict")
    )


def plan_sources(mode: str, now_ist: datetime | None = None) -> tuple[str, ...]:
    """Which feeds a run reads. Auto: all on weekday market minutes, a few in waking hours, none at night."""
    fixed = {"fast": ("news", "press", "bse", "nse"), "news": ("news", "press"), "slow": ("sebi",)}
    if mode in fixed:
        return fixed[mode]
    minute = now_ist.hour * 60 + now_ist.minute
    if now_ist.weekday() < 5 and 540 <= minute <= 1110:
        return ("news", "press", "bse", "nse", "sebi")
    return ("news", "press", "sebi") if 420 <= minute <= 1380 else ()
