"""Cleaning rules for extracted field texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import cut_before, strip

RUPEE = "₹"
OUT_OF_STOCK = "Out of stock"
# A maker text ends before each of these, tested in order.
MAKER_STOPS = ("Packer", "Seller", "Imported by", "Brand:", "Manufacturer:")
MAKER_LABEL = "^(Brand:|Manufacturer:)"


def clean_price(price: Column) -> Column:
    """Keep digits, ``.``, ``,`` and the rupee sign; put the sign in front if absent.

    Blank prices stay as they are. Dollar signs are removed before the sign test, so
    every currency ends up with the rupee sign.
    """
    kept = F.regexp_replace(price, r"[^\p{Nd}.,₹]", "")
    signed = F.when(F.contains(kept, F.lit(RUPEE)), kept).otherwise(
        F.concat(F.lit(RUPEE), kept)
    )
    return F.when(price != "", signed).otherwise(price)


def with_stock(price: Column, availability: Column) -> Column:
    """Replace the price where the availability text says the item is gone."""
    gone = F.contains(F.lower(availability), F.lit("out of stock"))
    return F.when(gone, F.lit(OUT_OF_STOCK)).otherwise(price)


def clean_maker(text: Column) -> Column:
    """Drop the leading label and colons, then cut at each stop marker."""
    bare = strip(F.btrim(strip(F.regexp_replace(text, MAKER_LABEL, "")), F.lit(":")))
    return reduce(lambda c, stop: strip(cut_before(c, stop)), MAKER_STOPS, bare)
