"""Operators for preparing training text: packing, scoring, near duplicates, tokens, scans."""
