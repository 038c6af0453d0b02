"""Column expressions: URL, platform, text, selector and cleaning functions."""
