"""DataFrame operators: parsing, upserts, aggregates, history, charts, checks."""
