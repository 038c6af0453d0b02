"""Input tables: pages, sessions, whitelist, platform dimension, CSV re-read."""
