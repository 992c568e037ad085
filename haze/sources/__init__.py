"""Readers, writers and the keyed feature table."""
