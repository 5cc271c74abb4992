"""Small daily panels whose rankings can be worked out by hand."""

from __future__ import annotations

import datetime as dt

FIRST = dt.date(2026, 1, 5)
DAILY = (
    "ticker string, trading_date date, open_price decimal(10,2), high_price decimal(10,2), "
    "low_price decimal(10,2), close_price decimal(10,2), trading_value bigint"
)


def day(n: int) -> dt.date:
    return FIRST + dt.timedelta(days=n - 1)


def panel(spark, rows):
    """rows: (ticker, day number or date, value, close or None)."""
    from decimal import Decimal

    data = [
        (t, d if isinstance(d, dt.date) else day(d), None, None, None, None if c is None else Decimal(str(c)), v)
        for t, d, v, c in rows
    ]
    return spark.createDataFrame(data, DAILY)


def stocks(spark, *tickers):
    return spark.createDataFrame(
        [(t, "N" + t, "TPEX" if t == "6488" else "TWSE") for t in tickers], "ticker string, name string, market string"
    )


def values(ticker, *vals, start=1, close=None):
    return [(ticker, start + i, v, close) for i, v in enumerate(vals) if v is not None]
