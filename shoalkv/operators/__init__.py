"""Operators over mutations: memtables and their accounting, and the cache."""
