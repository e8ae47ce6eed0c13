"""Every constant of the engine in one frozen value. All thresholds in crore (1e7 INR) unless named otherwise."""

from __future__ import annotations

from dataclasses import dataclass

# Word lists, domains and patterns that results depend on.
TRANSACTION_WORDS = ("sold", "sells", "sale", "stake", "deal", "acquire", "acquisition", "buy", "offer", "ofs", "block", "divest")
VALUATION_WORDS = ("revenue", "turnover", "profit", "pat", "ebitda", "market cap", "m-cap", "order book", "target price", "per annum", "annually", "capex")
STRUCTURAL_URLS = ("/liveblog/", "/stock-liveblog/", "/slideshow/", "/photostory/", "/videoshow/")
STRUCTURAL_TITLES = ("share price live updates", "stock price live")
DEDUP_EXEMPT_SOURCES = ("NSE", "BSE", "SEBI")
DEDUP_STOPWORDS = (
    "promoter", "promoters", "sells", "sell", "sold", "sale", "stake", "shares", "share", "block", "bulk", "deal", "crore", "cr", "rs", "worth",
    "per", "cent", "buy", "buys", "acquires", "acquired", "in", "for", "to", "of", "the", "a", "at", "via", "after", "as", "over", "likely",
)
NORMALISE_STOPWORDS = ("private", "limited", "ltd", "pvt", "inc", "corp", "technologies", "industries", "enterprises")
CLUSTER_STOPWORDS = (
    "private", "limited", "ltd", "pvt", "inc", "corp", "corporation", "technologies", "technology", "industries", "enterprises", "group", "holdings",
    "india", "company", "co", "and", "the", "engineering", "services", "solutions",
)
TRAIL_MARKERS = ("formerly", "erstwhile", "a unit of", "division of", "arm of", "business of")
PERSON_TITLES = ("mr", "mrs", "ms", "miss", "shri", "smt", "dr", "kum", "km", "late")
INSTITUTION_KEYWORDS = (
    "fund", "mutual", "amc", "llp", "securities", "capital", "advisors", "advisers", "partners", "mauritius", "pte", "plc", "gmbh",
    "sicav", "insurance", "bank", "asset management", "portfolio", "trustee", "fpi", "fii",
)
AMBIGUOUS_KEYWORDS = ("ltd", "limited", "pvt", "holdings", "enterprises", "trust", "corp", "investment", "investments", "global", "international", "ventures", "equity")
FILING_KEEP = (
    "acquisition", "acquire", "disposal", "sale of", "stake", "fund raising", "fund-raising", "fundraising", "raising of funds",
    "preferential", "qualified institution", "shareholding", "open offer", "scheme of arrangement", "insider trading", "sast",
    "reg. 7", "reg 7", "reg. 29", "reg 29", "reg. 31", "reg 31", "pledge", "encumbrance",
)
FILING_DROP = ("result", "board meeting", "newspaper publication", "trading window", "investor presentation", "analyst", "earnings call", "record date", "dividend")
LISTING_KEYWORDS = ("draft", "drhp", "prospectus", "offer document")
PIT_CATEGORIES = ("promoter", "promoter group", "director", "kmp")
PIT_FIELDS = {
    "trade_date": ("date", "acqfromDt", "intimDt", "disclosureDate"),
    "symbol": ("symbol", "SYMBOL"),
    "company": ("company", "companyName", "compName"),
    "person_name": ("acqName", "personName", "name", "acquirerDisposerName"),
    "category": ("personCategory", "category", "regPerCategory"),
    "trans_type": ("transactionType", "transType", "acqMode"),
    "quantity": ("secVal", "noOfSecurities", "securitiesAcquiredDisposed", "secAcq"),
    "value": ("valueOfSecurities", "value", "secValue"),
}
FX_MARKS = ("$", "usd", "dollar", "€", "eur", "£", "gbp")
FX_UNITS = {"billion": 1e9, "bn": 1e9, "million": 1e6, "mn": 1e6, "m": 1e6}
RULE_LABELS = {
    "Rule 1": "pure debt", "Rule 2": "IBC/NCLT", "Rule 3": "govt/PSU", "Rule 4": "subsidiary sale", "Rule 5": "intra-group",
    "Rule 6": "no Indian individual", "Rule 7": "seed/Series A primary", "Rule 8": "under 250cr", "Rule 9": "not a transaction",
    "Rule P": "failed precision check", "Rule S": "size band under 100cr", "Rule M": "BSE company under 1000cr mcap",
    "Rule X": "classifier never recovered — gave up", "Rule ?": "unclassified",
}
BAND_LABELS = {"100_TO_500": "Rs 100-500cr", "500_TO_2000": "Rs 500-2,000cr", "OVER_2000": "Rs 2,000cr+"}
VERDICTS = ("useful", "already_knew", "noise")
#: What news searches ask for by default; a parameter of the readers, results do not depend on it.
NEWS_QUERIES = ("promoter sells stake", "founder block deal", "family office sells shares", "offer for sale filing", "open offer promoter", "pre-IPO secondary sale")
TRADE_DATE_FORMATS = ("d-MMM-yyyy", "d-M-yyyy", "yyyy-M-d")


@dataclass(frozen=True)
class Config:
    threshold: float = 250.0
    mcap_plausible_min: float = 350.0
    filing_mcap_min: float = 1000.0
    proximity_chars: int = 60
    dedup_hours: int = 72
    dedup_jaccard: float = 0.85
    enforce: bool = True
    batch_size: int = 25
    description_chars: int = 400
    retry_attempts: int = 6
    retry_hours: int = 24
    warn_cooldown_minutes: int = 60
    usd_inr: float = 88.0
    eur_inr: float = 96.0
    name_window_hours: int = 72
    amount_window_hours: int = 168
    amount_tolerance: float = 0.05
    update_share: float = 0.20
    pit_days: int = 7
    pit_backfill_days: int = 90
    pattern_days: int = 90
    pattern_min: float = 250.0
    pattern_min_sales: int = 2
    pattern_max_share: float = 0.70
    realert_multiple: float = 2.0
    realert_days: int = 90
    mcap_ttl_days: int = 7
    digest_hours: int = 24
    feedback_days: int = 14
    query_stats_days: int = 7
    item_query_days: int = 30


DEFAULT = Config()
