"""Readers for files, landed payloads, block ranges and file inventories."""
