"""turnbook: turnover analytics for listed shares, written as PySpark jobs."""
