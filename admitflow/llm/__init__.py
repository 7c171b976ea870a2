"""Operators for preparing training text: scoring, scanning, extraction, formatting, deduplication, packing."""
