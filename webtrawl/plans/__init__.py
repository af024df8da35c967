"""Jobs made of several operators: crawl, index build, search, accounts, tasks."""
