"""The library's registered queries with their SQL."""
