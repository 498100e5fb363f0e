"""Tomeforge: retrieval over versioned text corpora, and its analytics, as Spark plans."""
