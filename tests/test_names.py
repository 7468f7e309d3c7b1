"""Company-key functions: golden rows from the documented examples and the trap list."""

import pytest
from pyspark.sql import functions as F

from lcarank.functions.names import (clean_company_name, company_key, despaced_variant,
                                     has_fuzzy_anchor, normalize_company, subset_anchors, token_sort)

NORMALIZE = [
    ("Google LLC", "google"),
    ("Amazon.com Services, Inc.", "amazon com services"),
    ("Ernst & Young U.S. LLP", "ernst young us"),
    ("The Coca-Cola Company", "coca cola"),
    ("", ""),
    (None, ""),
    ("J.P. Morgan Chase & Co.", "jp morgan chase"),
    ("Vitamin C N.A.", "vitamin cna"),          # initials joined before suffixes are stripped
    ("Citibank N.A.", "citibank"),
    ("The The Acme", "the acme"),               # one leading "the" per pass
    ("Inc", "inc"),                             # a lone suffix stays
    ("Acme Co., L.L.C.", "acme"),               # repeated suffixes
    ("Nestlé USA", "nestl usa"),                # non-ASCII letters separate tokens
    ("  ACME   corp  ", "acme"),
    ("The", "the"),
]


def _one(spark, fn, value):
    df = spark.createDataFrame([(value,)], "x string")
    return df.select(fn(F.col("x"))).first()[0]


@pytest.mark.parametrize("raw,key", NORMALIZE)
def test_normalize_company(spark, raw, key):
    assert _one(spark, normalize_company, raw) == key


def test_normalize_is_applied_once(spark):
    once = _one(spark, normalize_company, "The The Acme")
    assert _one(spark, normalize_company, once) == "acme"


CLEAN = [
    ("Acme Corp - Glassdoor 4.1", "Acme Corp"),
    ("Acme Corp via LinkedIn", "Acme Corp"),
    ("Acme Corp | Indeed", "Acme Corp"),
    ("Blue-Monster Energy", "Blue"),            # bare hyphen before a board name is a separator
    ("Web 2.0", "Web"),                         # trailing decimal reads as a rating
    ("  Initech  ", "Initech"),
    ("\u00a0Acme\u2003", "Acme"),            # Unicode whitespace stripped as in Python
    (None, ""),
]


@pytest.mark.parametrize("raw,clean", CLEAN)
def test_clean_company_name(spark, raw, clean):
    assert _one(spark, clean_company_name, raw) == clean


def test_company_key_after_cleaning(spark):
    assert _one(spark, company_key, "Stark Industries Inc - Glassdoor 3.9") == "stark industries"


@pytest.mark.parametrize("key,variant", [
    ("jp morgan", "jpmorgan"), ("ibm global", "ibmglobal"), ("acme widgets", None),
    ("ab", None), ("a b", None), ("", None), ("jp", None),
])
def test_despaced_variant(spark, key, variant):
    assert _one(spark, despaced_variant, key) == variant


def test_token_sort(spark):
    assert _one(spark, token_sort, "widgets acme blue") == "acme blue widgets"


@pytest.mark.parametrize("key,ok", [
    ("global tech solutions", False), ("acme", True), ("abc", True), ("ab data", False),
    ("tech data digital", False),
])
def test_fuzzy_anchor(spark, key, ok):
    assert _one(spark, has_fuzzy_anchor, key) is ok


def test_subset_anchors(spark):
    assert _one(spark, subset_anchors, "red rod") == []
    assert _one(spark, subset_anchors, "acme global acme tool") == ["acme", "tool"]
