"""Column layouts of the tables the jobs read and write (Spark DDL)."""

PRICE = "decimal(10,2)"
INDEX_VALUE = "decimal(20,4)"
PERCENT = "decimal(10,4)"

DAILY_QUOTE = (
    "market string, ticker string, name string, "
    f"open_price {PRICE}, high_price {PRICE}, low_price {PRICE}, close_price {PRICE}, "
    "trading_value bigint, trading_volume bigint, transaction_count int"
)

MARKET_INDEX = f"market string, value {INDEX_VALUE}, change_percent {PERCENT}"

# One line of a snapshot file.  A trading date may be spread over several lines;
# every line repeats the date and the three version counters, and says how many lines
# the date has and what its own content adds up to.
SNAPSHOT = (
    "schema_version int, trading_date date, is_trading_day boolean, downloaded_at timestamp_ntz, "
    f"quotes array<struct<{DAILY_QUOTE.replace(' ', ':').replace(',:', ',')}>>, "
    "market_index_schema_version int, "
    f"market_indices array<struct<{MARKET_INDEX.replace(' ', ':').replace(',:', ',')}>>, "
    "daily_bar_schema_version int, part int, parts int, checksum bigint"
)

# Versions of the three definitions a stored day is checked against (fixed values).
SCHEMA_VERSION = 2
MARKET_INDEX_SCHEMA_VERSION = 1
DAILY_BAR_SCHEMA_VERSION = 1

# Landed exchange report: a list of titled tables of positional rows.
REPORT = (
    "stat string, title string, fields array<string>, data array<array<string>>, "
    "tables array<struct<title:string,fields:array<string>,data:array<array<string>>>>"
)

# One polling response of the intraday feed.
INTRADAY_MESSAGE = (
    "captured_at timestamp_ntz, source string, "
    "msgArray array<struct<c:string,n:string,ex:string,d:string,z:string,pz:string,"
    "a:string,b:string,o:string,h:string,l:string,y:string,v:string>>"
)

TWSE, TPEX = "TWSE", "TPEX"
MARKETS = (TWSE, TPEX)
