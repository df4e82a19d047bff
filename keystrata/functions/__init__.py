"""Column functions: sizes, byte codecs and hashes."""
