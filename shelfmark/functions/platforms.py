"""Platform detection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Tests in order, first hit wins.
PLATFORM_ORDER = (
    "amazon",
    "flipkart",
    "myntra",
    "meesho",
    "ajio",
    "ebay",
    "redbubble",
    "snapdeal",
    "shopsy",
    "nykaa",
    "tatacliq",
    "indiamart",
    "walmart",
)
GENERIC = "generic"


def detect(host: Column) -> Column:
    """Name of the first shop whose ``name.`` occurs in the host, else ``generic``.

    The host expression occurs once in the result, so that filters on the platform
    stay small when the optimizer pushes them down.
    """
    names = F.array(*[F.lit(n) for n in PLATFORM_ORDER])
    return let(
        F.lower(host),
        lambda h: F.coalesce(
            F.get(F.filter(names, lambda n: F.contains(h, F.concat(n, F.lit(".")))), F.lit(0)),
            F.lit(GENERIC),
        ),
    )
