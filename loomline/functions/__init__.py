"""Column functions on text, JSON and digests."""
