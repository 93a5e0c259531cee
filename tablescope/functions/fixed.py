"""Word lists, patterns and tables that decide results and must stay as they are."""

# --- fixed values: missing-value markers -------------------------------------------------------------
STRONG_NULL = ["", "n/a", "na", "#n/a", "#na", "nan", "null", "nil", "(blank)", "(empty)", "(null)", "<null>"]
SOFT_NULL = ["none", "unknown", "-", "--", "—", "?", "."]
TRUE_WORDS = ["true", "yes", "y", "1"]
FALSE_WORDS = ["false", "no", "n", "0"]
TOTAL_ROW = r"(?i)^(grand\s+)?(total|totals|sum|subtotal)\b"

# --- fixed values: cell patterns ----------------------------------------------------------------------
CURRENCY_GLYPHS = "$€£¥₪₹₩₽₺฿₱₫₦₴₵₲₸₾₡"
CURRENCY_CELL = rf"^\s*\(?\s*([{CURRENCY_GLYPHS}]\s?[0-9.,]+|[0-9.,]+\s?[{CURRENCY_GLYPHS}])\s*\)?\s*$"
PERCENT_CELL = r"^\s*-?[0-9.,]+\s*%\s*$"
NUMERIC_CELL = r"^\s*-?[0-9,]+(\.[0-9]+)?\s*$"
NUMERIC_EU_CELL = r"^\s*-?[0-9]{1,3}(\.[0-9]{3})+(,[0-9]+)?\s*$|^\s*-?[0-9]+,[0-9]{1,2}\s*$"
DATE_CELL = (r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|^[0-9]{1,2}[/.][0-9]{1,2}[/.][0-9]{2,4}"
             r"|^[0-9]{1,2}\s+[A-Za-z]{3,}\s+[0-9]{2,4}|^[A-Za-z]{3,}\s+[0-9]{1,2},?\s+[0-9]{2,4}")

# --- fixed values: header patterns for type inference -------------------------------------------------
MONEY_HEADER = (r"(price|revenue|cost|amount|sales|profit|income|usd|eur|spend|balance|value|salary|salaries|wage|wages"
                r"|\bpay\b|paid|payment|payroll|fee|fees|rent|budget|expense|expenses|charge|turnover|invoice|earnings"
                r"|compensation)")
DATE_HEADER = r"(date|time|day|month|year|period|timestamp)"
ID_NUMBER_HEADER = r"(\bid\b|_id|id$|code|number|no\.|key|uuid|guid)"
ID_TEXT_HEADER = r"(\bid\b|_id|id$|uuid|guid|email|url|key)"

# --- fixed values: header patterns for what a metric means ----------------------------------------------
VALUE_NAME = (r"(?i)\b(revenue|sales?|amount|amt|turnover|gmv|spend(ing)?|cost|profit|gross|net|income|proceeds|booking"
              r"|bookings|payment|charge|invoice|deal[_\s-]?(value|size)|line[_\s-]?total|sub[_\s-]?total"
              r"|grand[_\s-]?total|total)\b")
REVENUE_NAME = (r"(?i)\b(revenue|sales?|turnover|gmv|income|proceeds|amount|amt|bookings?|net[_\s-]?sales"
                r"|gross[_\s-]?sales|grand[_\s-]?total)\b")
QUANTITY_NAME = r"(?i)\b(qty|quantity|units?|orders?|count|volume|sold|pieces?|items?|tickets?|seats?|bookings?)\b"
ATTRIBUTE_NAME = (r"(?i)(%|percent|\brate\b|ratio|\bavg\b|average|\bmean\b|median|margin|\bscore\b|rating|\bindex\b|\bage\b"
                  r"|\byear\b|\bid\b|\bno\.?\b|\bnumber\b|\bcode\b|\bzip\b|postal|phone|\blat(itude)?\b"
                  r"|\blon(gitude)?\b|\blng\b|tenure|\bdays?\b|temperature|\btemp\b|weight|height|\bbmi\b|distance"
                  r"|duration|\bgpa\b)")
UNIT_PRICE_NAME = r"(?i)\b(price|unit[_\s-]?price|msrp|list[_\s-]?price|fee|wage|salary|hourly|per[_\s-]?unit|rate)\b"
UNIT_PRICE_ONLY = r"(?i)\b(price|unit[_\s-]?price|msrp|list[_\s-]?price|sticker|fee|wage|salary|hourly|per[_\s-]?unit)\b"
PRODUCT_NAME = (r"(?i)\b(product|products|model|models|sku|item|items|service|services|plan|plans|brand|brands|category"
                r"|categories|type|variant|variants|title|make|line|tier|package)\b")
COST_NAME = r"(?i)\b(cogs|cost|costs|cost[_\s-]?of[_\s-]?goods)\b"
RATE_NAME = (r"(?i)(\brate\b|ratio|\bscore\b|rating|csat|\bnps\b|satisfaction|margin|percent|%|conversion|\bctr\b"
             r"|\broi\b|\baov\b|utilization|occupancy|accuracy|efficiency)")

# --- fixed values: domain keywords -----------------------------------------------------------------------
STRONG_FINANCIAL = (r"(?i)(\bclose\b|\bopen\b|\bhigh\b|\blow\b|ohlc|ticker|portfolio|\bnav\b|\byield\b|dividend"
                    r"|\bequity\b|adj[_\s-]?close|candlestick|drawdown|coupon|maturity|cusip|isin|sharpe)")
WEAK_FINANCIAL = r"(?i)(\bprice\b|\bvolume\b|\breturn\b|\bbalance\b|\basset\b|\binterest\b)"
SALES_WORDS = (r"(?i)(sales|revenue|orders?|quantity|\bqty\b|\bunits?\b|product|customer|client|invoice|profit|margin"
               r"|\bsku\b|region|stores?|\bprice\b|\bcost\b|discount|brand|model|make|dealer|vendor|supplier|category"
               r"|shipment|warehouse|inventory|payment|transaction|deal)")
MARKETING_WORDS = (r"(?i)(impression|click|\bctr\b|conversion|campaign|channel|spend|\bcpc\b|\bcpm\b|roas|\blead\b|session"
                   r"|bounce|audience|\breach\b|engagement)")
SURVEY_WORDS = (r"(?i)(rating|\bscore\b|response|question|satisfaction|\bnps\b|agree|likert|respondent|feedback|survey)")

INDUSTRY_KEYS = {
    "SaaS / subscriptions": ["mrr", "arr", "churn", "signup", "subscription", "trial", "seats", "active user",
                             "retention"],
    "Marketing / advertising": ["impression", "click", "ctr", "conversion", "campaign", "cpc", "cpm", "spend", "channel",
                                "roas", "audience"],
    "E-commerce / retail": ["order", "product", "sku", "units", "quantity", "cart", "discount", "category", "basket",
                            "checkout"],
    "Sales / revenue": ["revenue", "sales", "deal", "pipeline", "lead", "quota", "region", "rep", "account"],
    "Human resources": ["employee", "salary", "department", "tenure", "headcount", "attrition", "satisfaction", "hire",
                        "payroll", "role", "level"],
    "Real estate": ["sq ft", "sqft", "bedroom", "bathroom", "listing", "neighborhood", "rent", "property",
                    "days on market"],
    "Finance / investing": ["profit", "expense", "balance", "cash", "return", "portfolio", "asset", "yield", "interest",
                            "margin"],
    "Health / fitness": ["calorie", "heart rate", "workout", "steps", "weight", "bmi", "sleep", "activity", "duration",
                         "intensity"],
    "Survey / feedback": ["rating", "score", "response", "nps", "feedback", "satisfaction", "agree", "question",
                          "respondent"],
}

# --- fixed values: currencies ----------------------------------------------------------------------------
CODE_SYMBOL = {
    "USD": "$", "CAD": "$", "AUD": "$", "NZD": "$", "HKD": "$", "SGD": "$", "MXN": "$",
    "CLP": "$", "COP": "$", "ARS": "$", "TWD": "NT$",
    "EUR": "€", "GBP": "£", "JPY": "¥", "CNY": "¥", "RMB": "¥",
    "ILS": "₪", "NIS": "₪", "INR": "₹", "KRW": "₩", "RUB": "₽", "TRY": "₺", "THB": "฿", "PHP": "₱",
    "VND": "₫", "NGN": "₦", "UAH": "₴", "GHS": "₵", "PYG": "₲", "KZT": "₸", "GEL": "₾", "CRC": "₡",
    "BRL": "R$", "ZAR": "R", "EGP": "E£",
    "CHF": "CHF", "SEK": "kr", "NOK": "kr", "DKK": "kr", "ISK": "kr",
    "PLN": "zł", "CZK": "Kč", "HUF": "Ft", "RON": "lei", "BGN": "лв", "HRK": "kn",
    "AED": "AED", "SAR": "SAR", "QAR": "QAR", "KWD": "KWD", "BHD": "BHD", "OMR": "OMR", "JOD": "JOD",
    "IDR": "Rp", "MYR": "RM", "PKR": "₨", "LKR": "₨", "NPR": "₨", "BDT": "৳",
    "KES": "KSh", "MAD": "MAD", "TND": "TND",
}
CODE_ALIAS = {"NIS": "ILS", "RMB": "CNY"}
GLYPH_CODE = {
    "R$": "BRL", "NT$": "TWD", "E£": "EGP", "€": "EUR", "£": "GBP", "¥": "JPY", "₪": "ILS", "₹": "INR", "₩": "KRW",
    "₽": "RUB", "₺": "TRY", "฿": "THB", "₱": "PHP", "₫": "VND", "₦": "NGN", "₴": "UAH", "₵": "GHS", "₲": "PYG",
    "₸": "KZT", "₾": "GEL", "₡": "CRC", "$": "USD",
}
WORD_CODE = {
    "dollar": "USD", "dollars": "USD", "euro": "EUR", "euros": "EUR", "sterling": "GBP", "yen": "JPY", "yuan": "CNY",
    "renminbi": "CNY", "shekel": "ILS", "shekels": "ILS", "shekalim": "ILS", "rupee": "INR", "rupees": "INR",
    "ruble": "RUB", "rubles": "RUB", "rouble": "RUB", "roubles": "RUB", "lira": "TRY", "zloty": "PLN", "baht": "THB",
    "ringgit": "MYR", "rupiah": "IDR", "dirham": "AED", "riyal": "SAR", "rial": "SAR", "forint": "HUF", "koruna": "CZK",
    "reais": "BRL", "franc": "CHF", "francs": "CHF", "hryvnia": "UAH", "naira": "NGN", "taka": "BDT", "dong": "VND",
    "rand": "ZAR",
}

# --- fixed values: words for text themes and sentiment ------------------------------------------------------
STOP_WORDS = (
    "a an the and or but if then else for of to in on at by with from into over under again further "
    "is are was were be been being have has had do does did doing will would can could should may might must "
    "i you he she it we they him her its our your their this that these those there here what which who whom "
    "as so than too very just not no nor only own same s t can don it's i'm we're they're im dont "
    "me my mine us out up down off no yes about above after before between because while during all any each few more most "
    "other some such own get got really would also even much many one two it’s").split()
POSITIVE_WORDS = (
    "good great excellent amazing awesome love loved loving like helpful friendly fast easy best perfect happy "
    "satisfied recommend wonderful fantastic nice smooth reliable quality clean enjoy enjoyed pleasant impressed "
    "responsive efficient affordable value worth quick outstanding superb delightful brilliant").split()
NEGATIVE_WORDS = (
    "bad poor terrible awful hate hated horrible worst slow difficult hard confusing broken buggy expensive "
    "disappointed disappointing rude unhelpful unfriendly dirty late delayed wrong error problem issue issues "
    "frustrating frustrated annoying useless waste lacking missing crash crashes failed fails complaint refund").split()
NEGATORS = ["not", "no", "never", "n't", "without", "hardly", "barely"]
