"""Column functions: URL parsing, text statistics, hashing, page scraping, scoring arithmetic."""
