import pytest

from shelfmark.catalog import products


class Started(Exception):
    pass


def test_stream_gets_the_whole_variant_table(spark, monkeypatch):
    given = []

    def start(pages, variants, *rest):
        given.append(variants)
        raise Started

    part = spark.createDataFrame([(1,), (2,)], "page_id long")
    monkeypatch.setattr(products, "stream_pages", lambda spark, path: None)
    monkeypatch.setattr(products, "trusted_sellers", lambda spark, sf: None)
    monkeypatch.setattr(products.i, "variant_pages", lambda spark, sf: part)
    monkeypatch.setattr(products, "start_dual_sink", start)
    with pytest.raises(Started):
        products.stream_products(spark, "unused")
    assert given[0].count() == 2
