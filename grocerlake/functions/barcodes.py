"""Product codes: parsing, check digits, UPC-E expansion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LENGTHS = (8, 12, 13, 14)


def _digits(value: Column) -> Column:
    return value.rlike("^[0-9]+$") & F.length(value).isin(*LENGTHS)


def _decoded(value: Column) -> Column:
    """Percent-decoded, with plus signs kept and bad escapes left as they are; trimmed; no symbology prefix."""
    raw = F.coalesce(F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B"))), value)
    edge = r"^[\s]+|[\s]+$"
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, edge, ""), r"^\][A-Za-z][0-9]", ""), edge, "")


def digital_link_gtin(url: Column) -> Column:
    """The GTIN of an http(s) link: 14 digits after /01/ in the path, else the query's 01 or gtin; null otherwise."""
    is_link = url.rlike(r"^(?i:https?)://[^/?#]+")
    path = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    query = F.concat(F.lit("&"), F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), F.lit("&"))
    in_path = F.nullif(F.regexp_extract(path, r"/01/+([0-9]{14})(?:/|$)", 1), F.lit(""))
    keyed = [F.nullif(F.regexp_extract(query, rf"&{key}=([^&]*)&", 1), F.lit("")) for key in ("01", "gtin")]
    return F.when(is_link, F.coalesce(in_path, *[F.when(_digits(k), k) for k in keyed]))


def gs1_ai01(raw: Column) -> Column:
    """14 digits of application identifier 01, in brackets anywhere or bare at the start."""
    return F.nullif(F.regexp_extract(raw, r"(?:\(01\)|^01)([0-9]{14})(?:\x1d|$|[^0-9])", 1), F.lit(""))


def gtin_checksum_valid(code: Column) -> Column:
    """Whether the last digit fits the others, weighted 3 and 1 from the right; false for other texts, null for null."""
    n = F.length(code)
    digit = lambda i: F.substr(code, i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), F.lit(0), lambda acc, i: acc + digit(i) * F.when((n - i) % 2 == 1, 3).otherwise(1))
    return F.when(_digits(code), (10 - total % 10) % 10 == F.right(code, F.lit(1)).cast("int")).when(code.isNotNull(), F.lit(False))


def expand_upc_e(code: Column) -> Column:
    """The 12-digit form of an 8-digit UPC-E of number system 0 or 1; null for others."""
    part = lambda a, n=1: F.substring(code, a, n)
    last = part(7)
    body = (
        F.when(last.isin("0", "1", "2"), F.concat(part(1, 3), last, F.lit("0000"), part(4, 3)))
        .when(last == "3", F.concat(part(1, 4), F.lit("00000"), part(5, 2)))
        .when(last == "4", F.concat(part(1, 5), F.lit("00000"), part(6)))
        .otherwise(F.concat(part(1, 6), F.lit("0000"), last))
    )
    return F.when(code.rlike("^[01][0-9]{7}$"), F.concat(body, part(8)))


def normalize_product_code(value: Column, source_format: Column | None = None) -> Column:
    """struct(gtin, source_format, checksum_valid, source_kind, reject_reason).

    A digital link comes before application identifier 01, and that before plain
    digits.  Codes that cannot be read have only a reason: ``empty``, ``unsupported`` or ``bad_upc_e``.
    """
    kind = F.upper(F.trim(source_format)) if source_format is not None else F.lit(None).cast("string")
    raw = F.coalesce(_decoded(value), F.lit(""))
    link, identifier = digital_link_gtin(raw), gs1_ai01(raw)
    plain = F.regexp_replace(raw, r"[\s-]", "")
    is_upc_e = F.coalesce(kind == "UPC_E", F.lit(False))
    linear = F.when(_digits(plain), F.when(is_upc_e, expand_upc_e(plain)).otherwise(plain))
    gtin = F.coalesce(link, identifier, linear)
    reason = F.when(gtin.isNotNull(), F.lit(None)).when(raw == "", "empty").when(_digits(plain) & is_upc_e, "bad_upc_e").otherwise("unsupported")
    source = F.when(link.isNotNull(), "gs1_digital_link").when(identifier.isNotNull(), "gs1_ai_01").when(linear.isNotNull(), "linear")
    name = F.when(gtin.isNotNull(), F.when(link.isNotNull(), F.coalesce(kind, F.lit("QR_CODE"))).otherwise(kind))
    return F.struct(gtin.alias("gtin"), name.alias("source_format"), gtin_checksum_valid(gtin).alias("checksum_valid"), source.alias("source_kind"), reason.alias("reject_reason"))
