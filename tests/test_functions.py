import pytest
from pyspark.sql import functions as F

from grocerlake.functions import barcodes as bc
from grocerlake.functions import text as tx


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first().x


CODES = [
    ("96385074", "EAN_8", "96385074", "linear"),
    ("04252614", "UPC_E", "042100005264", "linear"),
    ("(01)09506000134352", None, "09506000134352", "gs1_ai_01"),
    ("]d20109506000134352\x1d17271231", None, "09506000134352", "gs1_ai_01"),
    ("https://id.gs1.org/01/09506000134352/10/ABC123", None, "09506000134352", "gs1_digital_link"),
    ("https://example.com/lookup?gtin=4006381333931", None, "4006381333931", "gs1_digital_link"),
    ("4006 3813-3393 1", None, "4006381333931", "linear"),
]


def test_codes_are_read(spark):
    df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(CODES)], "i int, code string, f string")
    got = df.select("i", bc.normalize_product_code(F.col("code"), F.col("f")).alias("r")).select("i", "r.*").orderBy("i").collect()
    assert [(g.gtin, g.source_kind, g.reject_reason) for g in got] == [(c[2], c[3], None) for c in CODES]


@pytest.mark.parametrize("code, reason", [("", "empty"), (None, "empty"), ("ABC-123", "unsupported"), ("https://example.com/promo", "unsupported"), ("1234567890", "unsupported")])
def test_bad_codes_have_a_reason(spark, code, reason):
    got = one(spark, bc.normalize_product_code(F.col("code")), code=code)
    assert (got.gtin, got.reject_reason) == (None, reason)


@pytest.mark.parametrize("code, good", [("96385074", True), ("036000291452", True), ("4006381333931", True), ("10012345000017", True), ("4006381333932", False), ("x", False), (None, None)])
def test_check_digits(spark, code, good):
    assert one(spark, bc.gtin_checksum_valid(F.col("code")), code=code) is good


def test_tokens(spark):
    words = one(spark, tx.tokenize(F.col("t"), True, True), t="Toi di ung sua va muoi")
    assert {"allergen", "milk", "sodium"} <= set(words) and "toi" not in words
    assert one(spark, tx.tokenize(F.col("t")), t=None) == []


def test_redaction_order(spark):
    text = "mail a.b@c.org or +84 912 345 678, api_key = abc123"
    assert one(spark, tx.redact_sensitive(F.col("t")), t=text) == "mail [redacted] or +[redacted], [redacted]"


def test_folding_and_terms(spark):
    assert one(spark, tx.fold_accents(F.col("t")), t="Đường, SỮA  bò!") == "duong sua bo"
    assert one(spark, tx.contains_term(F.col("t"), "ca"), t="cacao") is False


def test_error_rate_counts_letters(spark):
    assert one(spark, tx.cer(F.col("a"), F.col("b")), a="đường", b="duong") == 0.6
    assert one(spark, tx.cer(F.col("a"), F.col("b")), a="", b="xy") == 2.0


def test_routes(spark):
    assert one(spark, tx.classify_route(F.col("q"), F.col("b")), q="Sản phẩm này là gì", b=None) == "mixed"
    assert one(spark, tx.classify_route(F.col("q"), F.col("b")), q="x", b="1") == "mixed"
    assert one(spark, tx.classify_route(F.col("q"), F.col("b")), q="allergen?", b="") == "product"
    assert one(spark, tx.classify_route(F.col("q"), F.col("b")), q="nothing", b=None) == "rag"
