"""Rule data per platform and the end-to-end batch flows."""
