"""Training-data operators: one module per operator, with the queries in ``queries``."""
