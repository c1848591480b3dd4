"""Column expressions: text, dates, links, posting keys and JSON payload fields."""
