"""The batch queue as a stream of files."""
