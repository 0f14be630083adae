"""Corpus preparation operators for large text collections.  Nothing outside imports this."""
