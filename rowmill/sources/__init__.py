"""Readers, writers, tables and the record envelope."""
