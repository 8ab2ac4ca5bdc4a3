"""Names, thresholds and lookup tables that results depend on."""

# Vendor field, our field, reported as a percentage.
FUNDAMENTAL_FIELDS = [
    ("trailingPE", "trailing_pe", False),
    ("forwardPE", "forward_pe", False),
    ("revenueGrowth", "revenue_growth", False),
    ("profitMargins", "profit_margin", False),
    ("returnOnEquity", "return_on_equity", False),
    ("debtToEquity", "debt_to_equity", True),
    ("dividendYield", "dividend_yield", True),
    ("beta", "beta", False),
    ("marketCap", "market_cap", False),
    ("priceToBook", "price_to_book", False),
]

# Above these sizes a ratio is a units error.
PLAUSIBLE_CEILING = {"dividend_yield": 0.60, "profit_margin": 5.0, "revenue_growth": 50.0, "return_on_equity": 50.0}

# Smallest sample for each confidence label, and the label's ranking weight.
CONFIDENCE = [(100, "high", 1.0), (30, "moderate", 0.75), (10, "low", 0.4)]

# Search key, symbol, instrument type.
SEARCH_KEYS = [
    ("apple", "AAPL", "EQUITY"), ("microsoft", "MSFT", "EQUITY"), ("nvidia", "NVDA", "EQUITY"),
    ("amazon", "AMZN", "EQUITY"), ("google", "GOOGL", "EQUITY"), ("alphabet", "GOOGL", "EQUITY"),
    ("meta", "META", "EQUITY"), ("facebook", "META", "EQUITY"), ("tesla", "TSLA", "EQUITY"),
    ("netflix", "NFLX", "EQUITY"), ("coca cola", "KO", "EQUITY"), ("coke", "KO", "EQUITY"),
    ("ford", "F", "EQUITY"), ("gamestop", "GME", "EQUITY"), ("palantir", "PLTR", "EQUITY"),
    ("berkshire", "BRK-B", "EQUITY"), ("johnson", "JNJ", "EQUITY"), ("exxon", "XOM", "EQUITY"),
    ("jpmorgan", "JPM", "EQUITY"), ("s&p 500", "SPY", "ETF"), ("sp500", "SPY", "ETF"),
    ("the market", "SPY", "ETF"), ("nasdaq", "QQQ", "ETF"), ("dow", "DIA", "ETF"),
    ("russell", "IWM", "ETF"), ("gold", "GLD", "ETF"), ("oil", "USO", "ETF"),
    ("bitcoin", "BTC-USD", "CRYPTOCURRENCY"), ("ethereum", "ETH-USD", "CRYPTOCURRENCY"), ("vix", "^VIX", "INDEX"),
    ("euro", "EURUSD=X", "CURRENCY"), ("eurusd", "EURUSD=X", "CURRENCY"), ("pound", "GBPUSD=X", "CURRENCY"),
    ("yen", "USDJPY=X", "CURRENCY"),
]

# Everyday spelling to symbol, and the currency codes that form pairs.
ALIASES = {
    "S&P": "SPY", "S&P500": "SPY", "SP500": "SPY", "SPX": "SPY", "THE S&P": "SPY", "S AND P": "SPY", "SANDP": "SPY",
    "NASDAQ": "QQQ", "THE NASDAQ": "QQQ", "NDX": "QQQ", "DOW": "DIA", "THE DOW": "DIA", "DJIA": "DIA",
    "RUSSELL": "IWM", "RUSSELL2000": "IWM", "SMALL CAPS": "IWM", "BITCOIN": "BTC-USD", "BTC": "BTC-USD",
    "ETHEREUM": "ETH-USD", "ETH": "ETH-USD", "GOLD": "GLD", "OIL": "USO", "CRUDE": "USO", "VIX": "^VIX",
    "THE VIX": "^VIX", "APPLE": "AAPL", "TESLA": "TSLA", "MICROSOFT": "MSFT", "AMAZON": "AMZN", "GOOGLE": "GOOGL",
    "ALPHABET": "GOOGL", "NVIDIA": "NVDA", "META": "META", "FACEBOOK": "META", "NETFLIX": "NFLX",
}
CURRENCIES = ["USD", "EUR", "GBP", "JPY", "CHF", "AUD", "NZD", "CAD", "SEK", "NOK", "MXN", "CNY"]
