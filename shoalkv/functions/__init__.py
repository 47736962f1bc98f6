"""Scalar functions: hashes and filters, paths and names, latency and its statistics."""
