"""Spark jobs for privacy-aware handling of scanned application documents."""
