"""Fixed values.

Word lists, patterns, tolerances and constants that define the results. They are
data, not logic: changing one changes what an operator returns.
"""

# --- cleaning -----------------------------------------------------------------
DELIMITERS = [",", ";", "|", "\t"]
SNIFF_LINES = 5
HEADER_MIN_FILLED = 0.5
TOTAL_ROW_PATTERN = r"(?i)^\s*(total|subtotal|grand total|sum)\s*$"
YEAR_HEADER_PATTERN = r"^\d{4}$"
MONTH_HEADER_PATTERN = (
    r"(?i)^(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
    r"|january|february|march|april|june|july|august|september|sept|october|november|december)"
    r"([^a-z].*)?$"
)
WIDE_MIN_HEADERS = 3
CURRENCY_SYMBOLS = ["$", "€", "£", "¥", "₹"]
CURRENCY_CLASS = r"[$€£¥₹]"
US_NUMBER_PATTERN = r"^-?\d{1,3}(,\d{3})*(\.\d+)?%?$"
EU_NUMBER_PATTERN = r"^-?\d{1,3}(\.\d{3})*(,\d+)?%?$"
PLAIN_NUMBER_PATTERN = r"^-?\d+(\.\d+)?%?$"
NUMBER_MATCH_RATE = 0.8
DATE_PARSE_RATE = 0.7
AMBIGUOUS_DATE_RATE = 0.5
# Date format -> shapes of the texts it can parse, with 9 for a digit and a for a letter; other texts are not
# tried. Where several formats parse as much, the first one counts.
DATE_FORMATS = {
    "yyyy-MM-dd": ["9999-99-99"],
    "yyyy-MM-dd HH:mm:ss": ["9999-99-99 99:99:99"],
    "yyyy-MM-dd'T'HH:mm:ss": ["9999-99-99a99:99:99"],
    "M/d/yyyy": ["9/9/9999", "9/99/9999", "99/9/9999", "99/99/9999"],
    "yyyy/M/d": ["9999/9/9", "9999/9/99", "9999/99/9", "9999/99/99"],
    "d-MMM-yyyy": ["9-aaa-9999", "99-aaa-9999"],
    "MMM d, yyyy": ["aaa 9, 9999", "aaa 99, 9999"],
    "d/M/yyyy": ["9/9/9999", "9/99/9999", "99/9/9999", "99/99/9999"],
    "d.M.yyyy": ["9.9.9999", "9.99.9999", "99.9.9999", "99.99.9999"],
    "M-d-yyyy": ["9-9-9999", "9-99-9999", "99-9-9999", "99-99-9999"],
    "d-M-yyyy": ["9-9-9999", "9-99-9999", "99-9-9999", "99-99-9999"],
    "yyyy.M.d": ["9999.9.9", "9999.9.99", "9999.99.9", "9999.99.99"],
    "yyyyMMdd": ["99999999"],
    "yyyy-MM-dd HH:mm": ["9999-99-99 99:99"],
    "M/d/yyyy H:mm": [f"{d} {t}" for d in ("9/9/9999", "9/99/9999", "99/9/9999", "99/99/9999") for t in ("9:99", "99:99")],
    "d/M/yyyy H:mm": [f"{d} {t}" for d in ("9/9/9999", "9/99/9999", "99/9/9999", "99/99/9999") for t in ("9:99", "99:99")],
    "d.M.yyyy H:mm": [f"{d} {t}" for d in ("9.9.9999", "9.99.9999", "99.9.9999", "99.99.9999") for t in ("9:99", "99:99")],
    "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]": ["9999-99-99 99:99:99." + "9" * n for n in range(1, 7)],
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S][XXX]": [
        "9999-99-99a99:99:99" + fraction + zone
        for fraction in ("", *("." + "9" * n for n in range(1, 7)))
        for zone in ("", "a", "+99:99", "-99:99")
        if fraction or zone
    ],
    "yyyy-MM-dd HH:mm:ssXXX": ["9999-99-99 99:99:99+99:99", "9999-99-99 99:99:99-99:99"],
}
AMBIGUOUS_DATE_FORMAT = "M/d/yyyy"

# Sentences of the cleaning log.
ENCODING_STEP = "Detected encoding: {}"
DELIMITER_STEP = "Detected delimiter: {}"
HEADER_STEP = "Skipped {} title row(s) above data header."

# --- data dictionary ----------------------------------------------------------
DATE_NAME_WORDS = ["date", "time", "year", "month", "day", "period"]
IDENTIFIER_NAME_WORDS = ["id", "uuid", "key", "code", "sku", "number"]
IDENTIFIER_DISTINCT_RATE = 0.8
MEASURE_DIGIT_RATE = 0.8
# Digits among currency signs, separators, blanks and percent signs.
MEASURE_TEXT_PATTERN = r"^[$€£¥₹,. %]*\d[\d$€£¥₹,. %]*$"
DIMENSION_MAX_DISTINCT = 50
DIMENSION_MAX_RATE = 0.5
CURRENCY_RATE = 0.3

# --- profiling ----------------------------------------------------------------
PII_NAME_WORDS = ["name", "first", "last", "surname", "forename", "fullname", "customer"]
EMAIL_PATTERN = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
PHONE_PATTERN = r"(\+?\d[\d\s\-().]{7,}\d)"
PII_RATE = 0.3
TOP_CATEGORIES = 10
SAMPLE_VALUES = 5
TABLE_SAMPLE_ROWS = 200

# --- quality ------------------------------------------------------------------
MISSING_ERROR_PCT = 20
EXTREME_IQR_FACTOR = 3.0
NON_NEGATIVE_WORDS = ["revenue", "sales", "price", "cost", "quantity", "qty"]

# --- analysis -----------------------------------------------------------------
IQR_FACTOR = 1.5
Z_THRESHOLD = 2.5
ENGINE_VERSION = "1.0"
DRILL_ROWS = 100
MAX_PAGE_SIZE = 500

# --- statistical guards -------------------------------------------------------
FDR_ALPHA = 0.05
FLAT_SLOPE_RATIO = 0.1
STABLE_PCT = 20
STABLE_MIN_PERIODS = 4
GROUP_MIN_ROWS = 30
GROUP_MIN_SHARE = 0.01
OUTLIER_TOP_PCT = 0.01
OUTLIER_SENSITIVE_PCT = 10
AGREEMENT_PCT = 10
SUFFICIENT_MIN_ROWS = 30

# --- join safety --------------------------------------------------------------
JOIN_MATCH_RATE = 0.9
JOIN_INVARIANCE_PCT = 1.0

# --- validation ---------------------------------------------------------------
RECOMPUTE_TOLERANCE = 0.001
NUMBER_TOLERANCE = 0.01
EVIDENCE_MIN_ROWS = 5
COVERAGE_MIN = 0.8
NON_EMPIRICAL_CLAIMS = ["definition", "suggestion", "question"]

# Phrases that assert a cause, each with the associational wording replacing it.
CAUSAL_REWRITES = {
    "caused": "is associated with",
    "because": "in a pattern consistent with",
    "due to": "coinciding with",
    "led to": "corresponds with",
    "driven by": "accounts for",
    "resulted in": "coincides with",
    "responsible for": "associated with",
    "proved that": "suggests that",
    "confirms that": "is consistent with",
    "shows that": "is associated with",
    "demonstrates that": "is consistent with",
    "therefore": "which corresponds with",
    "consequently": "and correspondingly",
    "explains why": "is associated with",
}

# Multiplier of each number suffix.
NUMBER_SUFFIXES = {
    "%": 0.01,
    "k": 1e3,
    "thousand": 1e3,
    "m": 1e6,
    "million": 1e6,
    "bn": 1e9,
    "billion": 1e9,
}

# --- request routing ----------------------------------------------------------
REPORT_WORDS = [
    "report", "summary", "generate report", "export", "full analysis", "comprehensive",
    "overview report", "write up",
]
INVESTIGATION_WORDS = [
    "why", "explain", "investigate", "what caused", "what drove", "what happened", "root cause",
    "insight", "dig into", "deep dive", "anomaly", "anomalies", "unusual", "unexpected",
]
ANALYSIS_WORDS = [
    "compare", "comparison", "by region", "by product", "by category", "by segment", "breakdown",
    "split", "top", "bottom", "rank", r"vs\.?", "versus",
]
LOOKUP_WORDS = [
    "what is", "what was", "how much", "how many", "total", "count", "sum", "show me", "give me",
    "tell me",
]
LOOKUP_MAX_WORDS = 12
INVESTIGATION_MIN_WORDS = 20
WHY_WORDS = ["why", "explain", "what caused", "investigate"]
COMPARISON_WORDS = [
    "vs", "versus", "compare", "difference", "change", "growth", "decline", "increase", "decrease",
]
TIME_EXPRESSION_PATTERNS = [
    r"last (?:month|quarter|year|week)",
    r"this (?:month|quarter|year)",
    r"q[1-4]\s*\d{4}",
    r"\d{4}",
    r"ytd|year to date",
]

# --- semantic layer -----------------------------------------------------------
# Metric name -> aggregate expressions in order of preference.
SALES_METRIC_PACK = {
    "revenue": [
        'SUM("net_sales")', 'SUM("revenue")', 'SUM("sales")', 'SUM("gross_sales")',
        'SUM("amount")',
    ],
    "orders": [
        'COUNT(DISTINCT "order_id")', 'COUNT(DISTINCT "transaction_id")',
        'COUNT(DISTINCT "order_number")', "COUNT(*)",
    ],
    "aov": [
        'SUM("revenue") / NULLIF(COUNT(DISTINCT "order_id"), 0)',
        'SUM("net_sales") / NULLIF(COUNT(DISTINCT "order_id"), 0)',
        'SUM("sales") / NULLIF(COUNT(DISTINCT "transaction_id"), 0)',
    ],
    "gross_margin": [
        '(SUM("revenue") - SUM("cogs")) / NULLIF(SUM("revenue"), 0)',
        '(SUM("net_sales") - SUM("cost")) / NULLIF(SUM("net_sales"), 0)',
        '(SUM("sales") - SUM("cost_of_goods")) / NULLIF(SUM("sales"), 0)',
    ],
    "units": ['SUM("units")', 'SUM("quantity")', 'SUM("qty")', 'SUM("items")'],
    "customers": [
        'COUNT(DISTINCT "customer_id")', 'COUNT(DISTINCT "customer")', 'COUNT(DISTINCT "user_id")',
    ],
}

# --- chart data ---------------------------------------------------------------
FEW_PERIODS = 6
TOP_N = 10
OTHER_LABEL = "Other"
PIE_MAX_SEGMENTS = 5
MAX_BINS = 20
MAX_SERIES = 10

# What reads as a number once symbols and separators are gone.
PLAIN_DOUBLE = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"

# Numbers with at most three leading digits unless grouped, nothing alphabetic around them.
NARROW_NUMBER = (
    r"(?i)(?<![a-z])[-+]?"
    r"(?:\d{1,3}(?:,\d{3})*(?:\.\d+)?|\d{1,3}(?:\.\d{3})*(?:,\d+)?|\d+(?:\.\d+)?)"
    r"(?:%|\s*(?:million|billion|thousand|k|m|bn))?(?![a-z])"
)

# --- sentences ----------------------------------------------------------------
CAUSAL_VIOLATION = "Causal language detected: '%s' — use associational language instead."
COVERAGE_CAVEAT = "%.1f%% of left keys have no match in the right dataset. Rows will be dropped in an inner join."
MEASURE_CHANGED = "SUM(%s) changed by %.1f%% after join"
EMPTY_ROWS_STEP = "Removed {} fully empty rows."
TOTAL_ROWS_STEP = "Detected {} total/subtotal rows. Remove them to avoid double-counting."
WIDE_STEP = "Dataset appears to be in wide/pivot format. Consider unpivoting for analysis."
NUMBER_STYLES = {
    "us": "US-locale number",
    "eu": "EU-locale number (period as thousands, comma as decimal)",
    "plain": "plain number",
}
NUMBER_STEP = "Column '{}': parsed as {}."
DATE_STEP = "Column '{}': parsed as date."
AMBIGUOUS_DATE_NOTE = " ⚠ Ambiguous MM/DD vs DD/MM format — assumed MM/DD. Verify with data owner."
DUPLICATES_STEP = "{} duplicate rows detected."
EVIDENCE_LINE = "Evidence [%s]: %s"
