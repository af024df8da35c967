"""Column functions: HTML cleaning, links, tokens, times."""
