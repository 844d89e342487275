"""Thresholds, word lists and lookup tables that results depend on.

Everything here is data, stated in its natural order.  Code elsewhere takes these
as keyword defaults so that a job can run with other values.
"""

# --- fixed values: listing statistics ------------------------------------------
SALE_SOURCE = "chotot:s"
RENT_SOURCE = "chotot:u"
MIN_SAMPLES = 20
STALE_AFTER_DAYS = 3
CLIP_LOW = 0.05
CLIP_HIGH = 0.95
PRICE_BAND = (1.0, 3000.0)      # million VND per m2, sale lane
RENT_BAND = (0.02, 5.0)         # million VND per m2 and month
CAGR_MIN_DAYS = 180
CAGR_MIN_POINTS = 6
CAGR_MAX_ABS = 2.0
CHEAP_FACTOR = 1.15
RICH_FACTOR = 0.85

# --- fixed values: listing panel -------------------------------------------------
CUT_THRESHOLD = 0.02
SIZE_DRIFT = 0.02
GONE_AFTER_CRAWLS = 2
MIN_CRAWLS_FOR_GONE = 3
REPOST_DAYS = 7
REPOST_TOLERANCE = 0.02
AGENT_KNOWN_FROM = "2026-09-07"
MAX_PER_DISTRICT = 200
THIN_SAMPLE = 20
CONSISTENCY_TOLERANCE = 0.05

# --- fixed values: state land prices ----------------------------------------------
MIN_STREETS = 8
RATIO_BAND = (0.5, 100.0)
MIN_STREET_KEY = 4              # keys must be longer than this
LAND_PRICE_BAND = (10_000.0, 2_000_000_000.0)
WHOLE_STREET = "TRỌN ĐƯỜNG"
LAND_DOCUMENT = r"\d{1,4}/\d{4}/(?:QĐ-UBND|NQ-HĐND)"
PLANNING_DOCUMENT = r"^\d{1,4}/QĐ-TTg$"
PROVINCE_COUNT = 34

# --- fixed values: the 34 current provinces and the former names each absorbed ----
PROVINCES = [
    ("Hà Nội", ["Hà Nội", "Hà Tây"]),
    ("Bắc Ninh", ["Bắc Ninh", "Bắc Giang"]),
    ("Quảng Ninh", ["Quảng Ninh"]),
    ("Hải Phòng", ["Hải Phòng", "Hải Dương"]),
    ("Hưng Yên", ["Hưng Yên", "Thái Bình"]),
    ("Ninh Bình", ["Ninh Bình", "Nam Định", "Hà Nam"]),
    ("Cao Bằng", ["Cao Bằng"]),
    ("Tuyên Quang", ["Tuyên Quang", "Hà Giang"]),
    ("Lào Cai", ["Lào Cai", "Yên Bái"]),
    ("Thái Nguyên", ["Thái Nguyên", "Bắc Kạn"]),
    ("Lạng Sơn", ["Lạng Sơn"]),
    ("Phú Thọ", ["Phú Thọ", "Vĩnh Phúc", "Hòa Bình"]),
    ("Điện Biên", ["Điện Biên"]),
    ("Lai Châu", ["Lai Châu"]),
    ("Sơn La", ["Sơn La"]),
    ("Thanh Hóa", ["Thanh Hóa"]),
    ("Nghệ An", ["Nghệ An"]),
    ("Hà Tĩnh", ["Hà Tĩnh"]),
    ("Quảng Trị", ["Quảng Trị", "Quảng Bình"]),
    ("Huế", ["Thừa Thiên Huế", "Huế"]),
    ("Đà Nẵng", ["Đà Nẵng", "Quảng Nam"]),
    ("Quảng Ngãi", ["Quảng Ngãi", "Kon Tum"]),
    ("Khánh Hòa", ["Khánh Hòa", "Ninh Thuận"]),
    ("Gia Lai", ["Gia Lai", "Bình Định"]),
    ("Đắk Lắk", ["Đắk Lắk", "Phú Yên"]),
    ("Lâm Đồng", ["Lâm Đồng", "Đắk Nông", "Bình Thuận"]),
    ("Tây Ninh", ["Tây Ninh", "Long An"]),
    ("Đồng Nai", ["Đồng Nai", "Bình Phước"]),
    ("Hồ Chí Minh", ["Hồ Chí Minh", "Bình Dương", "Bà Rịa - Vũng Tàu"]),
    ("Vĩnh Long", ["Vĩnh Long", "Bến Tre", "Trà Vinh"]),
    ("Đồng Tháp", ["Đồng Tháp", "Tiền Giang"]),
    ("An Giang", ["An Giang", "Kiên Giang"]),
    ("Cần Thơ", ["Cần Thơ", "Hậu Giang", "Sóc Trăng"]),
    ("Cà Mau", ["Cà Mau", "Bạc Liêu"]),
]
PROVINCE_PREFIXES = ["tinh-", "thanh-pho-", "tp-"]
CATEGORY_SLUGS = {
    "Đất": "dat",
    "Nhà ở": "nha-rieng",
    "Căn hộ/Chung cư": "chung-cu",
    "Văn phòng, Mặt bằng kinh doanh": "van-phong",
}

# --- fixed values: screener --------------------------------------------------------
# metric name in the panel -> published key
METRIC_KEYS = {
    "pe": "pe", "pb": "pb", "ps": "ps", "ev_ebitda": "ev", "p_cf": "pcf",
    "dividend_yield": "dy", "roe": "roe", "roa": "roa", "roic": "roic",
    "gross_margin": "gpm", "ebit_margin": "ebitm", "net_margin": "npm",
    "debt_equity": "de", "current_ratio": "cr", "quick_ratio": "qr",
    "leverage": "lev", "asset_turnover": "at", "nim": "nim", "npl": "npl",
    "car": "car", "casa": "casa", "ldr": "ldr", "cir": "cir",
}
PERCENT_KEYS = ["roe", "roa", "roic", "gpm", "ebitm", "npm", "dy",
                "nim", "npl", "car", "casa", "ldr", "cir"]
PERCENTILE_KEYS = ["pe", "pb", "ps", "ev", "roe", "dy"]
BANK_ONLY_KEYS = ["nim", "npl", "car", "casa", "ldr", "cir"]
ZERO_MISSING_KEYS = ["roic", "de", "gpm"]
SANE_RANGES = {
    "npm": (-500.0, 500.0), "ebitm": (-500.0, 500.0), "gpm": (-500.0, 500.0),
    "roe": (-500.0, 500.0), "roa": (-500.0, 500.0), "roic": (-500.0, 500.0),
    "ldr": (0.0, 500.0), "de": (0.0, 100.0),
}
QUOTE_WINDOW_SESSIONS = 10
MIN_PRICE_DAYS = 30
MAX_GAP_DAYS = 10
MIN_PERCENTILE_HISTORY = 8
EXCHANGE_NAMES = {
    "hose": "HOSE", "hsx": "HOSE", "hnx": "HNX", "upcom": "UPCOM",
    "delisted": "Đã hủy niêm yết",
}
PUBLISH_GUARD_SHARE = 0.9

# --- fixed values: company dossier -----------------------------------------------------
DOSSIER_METRICS = {
    **METRIC_KEYS, "cash_ratio": "cash", "cash_cycle": "cycle", "market_cap": "mc",
    "ebitda": "ebitda", "deposit_growth": "dg", "loans_growth": "lg",
}
DOSSIER_PERCENT_KEYS = PERCENT_KEYS + ["dg", "lg"]
DOSSIER_BILLION_KEYS = ["mc", "ebitda"]
MAX_QUARTERS = 36
MAX_YEARS = 9
MAX_OWNERS = 40
MAX_RELATIONS = 80
MAX_EVENTS = 120
CORE_STATEMENT_FIELDS = [
    "isa1", "isa3", "isa5", "isa11", "isa20", "isb27", "isb40", "isb41",
    "iss42", "bsa2", "bsa6", "bsa15", "bsa53", "bsa54", "bsa78",
    "bsb103", "bsb113", "cfa18", "cfa26", "cfa34", "cfa35", "cfa38",
]
ANNUAL_STATEMENT_FIELDS = ["isa9", "isa10", "cfa19", "bsa36", "bsa9"]

# --- fixed values: breadth ---------------------------------------------------------------
BREADTH_MIN_HISTORY = 60
BREADTH_SESSIONS = 260
BREADTH_MIN_COVERAGE = 0.6
BREADTH_MIN_NAMES = 20
AD_CAP = 10.0

# --- fixed values: signals -----------------------------------------------------------------
ROUND_TRIP_COST = 0.004
STOP_SD = 2.0
TARGET_R = 2.0
MAX_HOLD = 30
MIN_HISTORY = 120
MIN_MARKET_CAP = 1000.0
VOL_SPIKE_MULT = 1.5
FLOW_LOOKBACK = 20
OBV_SLOPE_BARS = 10
MIN_LAYERS = 3
REGIME_MIN_NAMES = 30

# --- fixed values: option surface --------------------------------------------------------------
OPTION_MAX_DAYS = 400.0
STRIKE_BAND = 0.6
HORIZON_HOURS = 24.0
FLIP_BAND = (0.5, 1.5)
FLIP_STEPS = 40
TOP_LEVELS = 12
PIN_SHARE = 0.4
NEAR_FLIP = 0.02
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]

# --- fixed values: trend gate -------------------------------------------------------------------
GATE_VERSION = "trend-gate-1.0.0"
GATE = {"adx": 22.0, "er": 0.35, "slope": 0.05, "breakout": 0.1, "retest": 0.25,
        "chase": 1.0, "quote_age_ms": 90_000, "min_bars": 280}
GATE_ASSETS = ["BTC", "ETH", "XAU"]
# What a broker snapshot may hold, by section.
BROKER_FIELDS = {
    "snapshot": ["version", "asset", "status", "source", "quote", "h1", "h4", "updated_at"],
    "source": ["kind", "name"],
    "quote": ["price", "ask", "at"],
}
# Context labels, the assets that each speaks of, and how long a fact of it holds (ms).
CONTEXT = {
    "dollar": (("BTC", "ETH", "XAU"), 4 * 86_400_000),
    "gold_future": (("XAU",), 4 * 86_400_000),
    "etf_flow": (("BTC", "ETH"), 5 * 86_400_000),
    "dealer_gamma": (("BTC", "ETH"), 8 * 3_600_000),
    "sentiment": (("BTC", "ETH"), 2 * 86_400_000),
    "mvrv": (("BTC",), 3 * 86_400_000),
    "calendar": (("BTC", "ETH", "XAU"), 0),
}
DOLLAR_MOVE_PERCENT = 0.2

# --- fixed values: flows, news, boards -------------------------------------------------------------
FLOW_DAYS = 730
NEWS_DAYS = 30
NEWS_PER_SYMBOL = 10
MAX_SYMBOLS_PER_ARTICLE = 2
SYMBOL_BLOCKLIST = [
    "AAA", "API", "APP", "APS", "ART", "CAN", "CAP", "CEO", "COM", "DAD",
    "DAN", "DHA", "FIT", "GAS", "HAG", "HAX", "HOT", "ICT", "ITC", "KOS",
    "MBS", "NICE", "ONE", "POT", "SAM", "SEA", "SIP", "TIP", "TNT", "TOP",
]
LEGAL_WORDS = (
    r"\b(?:(?:cong ty\s+)?(?:trach nhiem huu han|thuong mai co phan|co phan)|"
    r"ctcp|tmcp|tnhh|cong ty me|cong ty con)\b"
)
AMBIGUOUS_PHRASES = ["phat trien do thi"]
AMBIGUOUS_NAME_SYMBOLS = ["HNB", "WCS"]
STOCK_CONTEXT_WORDS = ["mã", "cổ phiếu", "cp"]
RELATED_LIST_STAMP = r"\s+-\s+\d{2}-\d{2}-\d{4}"
PEGGED = ["USDC", "FDUSD", "TUSD", "BUSD", "DAI", "USDP", "EURI", "AEUR", "USD1", "RLUSD",
          "PYUSD", "USDE", "USDS", "EUR", "GBP", "TRY", "BRL", "ARS", "JPY"]
MIN_TURNOVER_USD = 1e6
DEAD_MARKERS = ["migrated to", "deprecated", "(old)", "[old]", "delisted", "sunset"]
MAX_DESCRIPTION = 1200
BOARD_PRICE_SCALE = 1000.0
BOARD_LOT = 10.0
BOARD_FOREIGN_VALUE_SCALE = 100.0
BOARD_ROOM_SCALE = 10.0
TURNOVER_MILLIONS = 1e6
UNIT_BAND = (0.5, 2.0)
DEPTH_FIELDS = ["bid1", "bid1_vol", "bid2", "bid2_vol", "bid3", "bid3_vol",
                "ask1", "ask1_vol", "ask2", "ask2_vol", "ask3", "ask3_vol"]
RATIO_FIELDS = {
    "pe": "pe", "pb": "pb", "ps": "ps", "evToEbitda": "ev_ebitda", "priceToCashFlow": "p_cf",
    "dividendYield": "dividend_yield", "marketCap": "market_cap", "roe": "roe", "roa": "roa",
    "roic": "roic", "grossMargin": "gross_margin", "ebitMargin": "ebit_margin",
    "afterTaxProfitMargin": "net_margin", "debtToEquity": "debt_equity",
    "currentRatio": "current_ratio", "quickRatio": "quick_ratio", "cashRatio": "cash_ratio",
    "financialLeverage": "leverage", "assetTurnover": "asset_turnover", "cashCycle": "cash_cycle",
    "ownersEquity": "owners_equity", "ebitda": "ebitda", "netInterestMargin": "nim", "npl": "npl",
    "car": "car", "casaRatio": "casa", "ldrLoanDepositRatio": "ldr", "cir": "cir",
    "loansGrowth": "loans_growth", "depositGrowth": "deposit_growth",
}
PROVINCE_TOTAL_CAP = 10_000
SHORTFALL_SHARE = 0.9

# --- fixed values: quality gate ----------------------------------------------------------------------
MAX_ROW_DROP = 0.05
EQUITY_PRICE_RANGE = (100.0, 5_000_000.0)
PERCENT_RANGE = (-200.0, 500.0)
US_MIN_ROWS = 30
US_MIN_SESSIONS = 200
FLOW_DAY_RANGE = (-5000.0, 5000.0)
GEX_SPOT_RANGE = {"btc": (1_000.0, 1_000_000.0), "eth": (50.0, 50_000.0)}
CONTEXT_BOUNDS = [
    ("market.dom_btc", 20.0, 90.0), ("market.dom_eth", 2.0, 40.0), ("mvrv.value", 0.2, 10.0),
    ("fng.value", 0.0, 100.0), ("network.hashrate", 1e8, 1e11), ("network.tx", 50_000.0, 2_000_000.0),
    ("tvl.value", 1e9, 1e13), ("market.mcap", 1e11, 1e14),
]
