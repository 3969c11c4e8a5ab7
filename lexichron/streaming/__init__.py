"""The bag merge over a stream."""
