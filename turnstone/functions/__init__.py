"""Column functions: text, dates, hashes, rule lists."""
