"""Readers and writers for reports, splits, predictions, embeddings and features."""
