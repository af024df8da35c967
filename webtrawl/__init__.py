"""Web-page analytics as Spark jobs: clean text, links, crawl, search, accounts.

Every public function takes and returns DataFrames (or Columns).  The package
never builds a session.
"""
