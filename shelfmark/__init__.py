"""Retail page analytics on Spark DataFrames.

Snapshots of web pages go in (``page_id, url, html``); product, variant,
quarantine and session tables come out. See README.md for a tour.
"""
