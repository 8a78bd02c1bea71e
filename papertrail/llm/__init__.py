"""Training-data operators over text corpora.  Nothing outside this package imports it."""
