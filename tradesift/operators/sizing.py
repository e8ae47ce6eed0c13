"""Deal sizes from market caps: ticker resolution, cached lookups, stake times cap, and the gates that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradesift.config import DEFAULT, Config
from tradesift.functions import names, text
from tradesift.operators import state


def ticker_map(master: DataFrame, id_col: str, suffix: str) -> DataFrame:
    """name_key, ticker: only names whose token set occurs once."""
    keyed = master.select(F.array_join(names.company_tokens(F.col("name")), " ").alias("name_key"), F.concat(F.trim(F.col(id_col)), F.lit(suffix)).alias("ticker"))
    return keyed.filter("name_key <> ''").groupBy("name_key").agg(F.max("ticker").alias("ticker"), F.count("*").alias("n")).filter("n = 1").drop("n")


def resolve_tickers(items: DataFrame, company: Column, nse: DataFrame, bse: DataFrame) -> DataFrame:
    """With ticker; the first exchange is preferred. The optimizer broadcasts a master list if its size allows."""
    keyed = items.withColumn("name_key", F.array_join(names.company_tokens(company), " "))
    both = keyed.join(nse.withColumnRenamed("ticker", "_n"), "name_key", "left").join(bse.withColumnRenamed("ticker", "_b"), "name_key", "left")
    return both.withColumn("ticker", F.coalesce("_n", "_b")).drop("_n", "_b", "name_key")


def market_caps(items: DataFrame, cache: DataFrame, as_of: Column, quotes: DataFrame | None = None, config: Config = DEFAULT) -> DataFrame:
    """With market_cap_cr: from the cache within its time, else from ``quotes`` (ticker, market_cap_cr) of a provider."""
    found = state.lookup_fresh(items, cache.select("ticker", "market_cap_cr", "fetched_at"), "ticker", as_of, config.mcap_ttl_days).drop("fetched_at")
    if quotes is None:
        return found
    return found.join(quoted(quotes).withColumnRenamed("market_cap_cr", "_q"), "ticker", "left").withColumn("market_cap_cr", F.coalesce("market_cap_cr", "_q")).drop("_q")


def quoted(quotes: DataFrame) -> DataFrame:
    """One quote for each ticker: of several the largest."""
    return quotes.groupBy("ticker").agg(F.bround(F.max("market_cap_cr"), 1).alias("market_cap_cr")).filter("market_cap_cr IS NOT NULL")


def fetched(tickers: DataFrame, cache: DataFrame, as_of: Column, quotes: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """New rows of the cache: tickers (asked for in this run) that it had no fresh row of and that a quote was found for."""
    asked = tickers.select("ticker").filter("ticker IS NOT NULL").distinct()
    stale = state.lookup_fresh(asked, cache.select("ticker", "market_cap_cr", "fetched_at"), "ticker", as_of, config.mcap_ttl_days).filter("fetched_at IS NULL").select("ticker")
    return stale.join(quoted(quotes), "ticker").select("ticker", "market_cap_cr", as_of.alias("fetched_at"))


def computed_size(mcap: Column, *texts: Column) -> Column:
    """struct(computed_cr, mcap_cr): stake percent times market cap, or the cap alone as a bound of what is plausible."""
    pct = text.stake_percent(F.concat_ws(" ", *texts))
    return F.struct(F.bround(mcap * pct / 100, 1).alias("computed_cr"), F.when(pct.isNull(), mcap).alias("mcap_cr"))


#: Where a deal's size may come from.
SIZE_SOURCES = ("computed", "stated", "mcap_plausible", "band", "unknown")


def size_gates(deals: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """``deals``: amount_cr, size (of computed_size, or null), size_band, size_basis. Adds amount_cr as resolved,
    size_source and rule (null: goes on)."""
    need = F.col("amount_cr").isNull()
    amount = F.coalesce("amount_cr", "size.computed_cr")
    source = (
        F.when(need & F.col("size.computed_cr").isNotNull(), "computed")
        .when(~need, "stated")
        .when(F.col("size.mcap_cr").isNotNull(), "mcap_plausible")
        .when(F.col("size_band").isin("100_TO_500", "500_TO_2000", "OVER_2000"), "band")
        .otherwise("unknown")
    )
    baseless = F.lower(F.trim(F.coalesce("size_basis", F.lit("")))) == "no information"
    rule = (
        F.when(need & (F.col("size.mcap_cr") < config.mcap_plausible_min) & F.col("size.computed_cr").isNull(), "Rule 8")
        .when(amount < config.threshold, "Rule 8")
        .when(amount.isNull() & F.col("size.mcap_cr").isNull() & (F.col("size_band") == "UNDER_100") & ~baseless, "Rule S")
    )
    return deals.withColumns({"_amount": amount, "size_source": source, "rule": rule}).drop("amount_cr").withColumnRenamed("_amount", "amount_cr")
