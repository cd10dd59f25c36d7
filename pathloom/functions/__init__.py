"""Column functions: path codecs, byte masks and value policies."""
