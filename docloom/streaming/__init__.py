"""Structured Streaming over folders of documents: the batch operators, on a stream."""
