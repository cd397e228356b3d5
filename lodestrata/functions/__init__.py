"""Column expressions: text, dates and guarded arithmetic. Everything but NFKD is native."""
