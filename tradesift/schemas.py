"""Schemas of feeds and state tables, as DDL; ``empty`` and ``conform`` bootstrap and evolve them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ITEM = "id string, source string, title string, url string, description string, source_query string"
STATE = {
    "items": "id string, source string, title string, url string, description string, title_norm string, source_query string, fetched_at timestamp",
    "deals": "id long, deal_key string, company string, deal_type string, amount_cr double, amount_raw string, individuals array<string>, seller string, "
    "buyer string, confidence string, one_line string, source string, url string, created_at timestamp, updated_at timestamp, size_source string, size_band string, confirmed boolean",
    "suppressed": "id long, title string, url string, rule string, amount_cr double, amount_raw string, gate string, created_at timestamp",
    "deal_members": "id long, deal_id long, title string, url string, attached_at timestamp",
    "market_caps": "ticker string, market_cap_cr double, fetched_at timestamp",
    "feedback": "id long, deal_id long, verdict string, chat_id string, created_at timestamp",
    "kv_state": "key string, value string",
    "individual_sales": "id long, person_key string, person_name string, company string, company_key string, trade_date string, value_cr double, source string, created_at timestamp",
    "pattern_alerts": "id long, person_key string, company_key string, total_cr double, alerted_at timestamp",
    "item_queries": "item_id string, query string, created_at timestamp",
    "prefilter_shadow": "id long, filter string, title string, url string, reason string, created_at timestamp",
    "title_dedup_log": "id long, title string, url string, matched_title string, similarity double, created_at timestamp",
    "funnel_runs": "id long, mode string, fetched long, already_seen long, structural_dropped long, title_deduped long, bse_mcap_gated long, pre_api_gated long, "
    "reached_stage1 long, reached_stage2 long, alerted long, created_at timestamp",
    "classify_retry": "item_id string, stage string, attempts int, first_failed_at timestamp, last_attempt_at timestamp",
}
FILING = "Table array<struct<SUBCATNAME:string,NEWSSUB:string,HEADLINE:string,SLONGNAME:string,SCRIP_CD:string,NEWSID:string,NEWS_DT:string,ATTACHMENTNAME:string>>"
ANNOUNCEMENT = "subject string, desc string, symbol string, attchmntFile string, an_dt string, dt string"
LARGE_DEAL = "struct<date:string,symbol:string,name:string,clientName:string,buySell:string,qty:string,watp:string>"
LARGE_DEALS = f"BULK_DEALS_DATA array<{LARGE_DEAL}>, BLOCK_DEALS_DATA array<{LARGE_DEAL}>"
TRADE = "trade_date string, symbol string, security_name string, client_name string, buy_sell string, quantity double, price double, value_cr double, exchange string, deal_type string"
DISCLOSURE = "trade_date string, symbol string, company string, person_name string, category string, trans_type string, value_cr double"
STAGE1 = "array<struct<n:int,neg:boolean,r:string>>"
STAGE2 = (
    "array<struct<n:int,qualify:boolean,drop_reason:string,company:string,deal_type:string,amount_cr:double,amount_raw:string,individuals:array<string>,"
    "seller:string,confidence:string,one_line:string,size_band:string,size_basis:string>>"
)


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], STATE[name])


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """``df`` with exactly the schema's columns: missing ones are null, others go. This is the additive migration."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(ddl)])
