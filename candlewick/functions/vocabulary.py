"""Word lists of the news tagger."""

from __future__ import annotations

# Keyword -> symbol, and the words of each sentiment.
SYMBOL_KEYWORDS = {
    "bitcoin": "BTC",
    "btc": "BTC",
    "ethereum": "ETH",
    "eth": "ETH",
    "solana": "SOL",
    "sol": "SOL",
    "bnb": "BNB",
    "xrp": "XRP",
    "ripple": "XRP",
    "dogecoin": "DOGE",
    "doge": "DOGE",
    "cardano": "ADA",
    "ada": "ADA",
    "tron": "TRX",
    "trx": "TRX",
    "avalanche": "AVAX",
    "avax": "AVAX",
    "chainlink": "LINK",
    "link": "LINK",
    "polkadot": "DOT",
    "polygon": "MATIC",
    "matic": "MATIC",
    "litecoin": "LTC",
    "ltc": "LTC",
    "stablecoin": "STABLE",
    "usdt": "USDT",
    "usdc": "USDC",
    "etf": "ETF",
}
POSITIVE = ["surge", "surged", "rally", "rallied", "bullish", "gains", "gained", "record", "high", "adoption", "approve", "approved", "launch", "launched", "growth", "recover", "recovered", "rebound", "breakthrough"]
NEGATIVE = ["crash", "crashed", "hack", "hacked", "bearish", "plunge", "plunged", "lawsuit", "fraud", "scam", "breach", "exploit", "fell", "drop", "dropped", "decline", "loss", "losses", "outflow", "outflows", "sinks", "tumble", "warning", "risk"]

#: For the invented prose of the test tables: some of its frequent words.
PROSE_KEYWORDS = {"the": "BTC", "of": "ETH", "and": "SOL", "etf": "ETF", "que": "XRP", "de": "ADA", "la": "DOT", "der": "LTC", "die": "LTC"}
PROSE_POSITIVE = ["is", "in", "le", "que", "und", "thing"]
PROSE_NEGATIVE = ["to", "by", "un", "des", "von", "est"]
