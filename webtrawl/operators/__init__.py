"""DataFrame operators: tables, ordered groups, pacing, stats, accounts, search."""
