"""Output tables: CSV/Parquet product and variant sinks and the session bundle."""
