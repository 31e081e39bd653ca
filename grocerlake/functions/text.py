"""Text analysis as column expressions."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words left out in ranking, and names that stand for English terms.
STOP_WORDS = (
    "trên tren nghĩa nghia trong sản san phẩm pham what does mean tôi toi này nay dùng dung được duoc không khong một mot nếu neu nên nen cần can"
).split()
ALIASES = {
    "đường": ["sugar", "sugars"], "duong": ["sugar", "sugars"], "muối": ["salt", "sodium"], "muoi": ["salt", "sodium"],
    "xơ": ["fiber"], "xo": ["fiber"], "cá": ["fish"], "ca": ["fish"], "béo": ["fat"], "beo": ["fat"],
    "dị": ["allergen", "allergy"], "ứng": ["allergen", "allergy"], "ung": ["allergen", "allergy"],
    "sữa": ["dairy", "milk"], "sua": ["dairy", "milk"], "hạn": ["expiry"], "han": ["expiry"],
    "bảo": ["storage"], "bao": ["storage"], "quản": ["storage"], "quan": ["storage"],
}
NUTRITION_TERMS = (
    "đường sugar sodium muối salt protein fiber xơ fat béo allergen dị ứng gluten lactose vegan vegetarian nutri score phụ gia expiry hạn nutrition dinh dưỡng "
    "trứng egg cá fish sữa yogurt chua yến mạch oat trái cây fruit thịt meat cà phê coffee tốt ăn uống"
).split()
REQUIRED_METADATA = "authority source_url jurisdiction risk_level effective_from expires_at reviewed_at evidence_level domains status".split()
INJECTION_PHRASES = ["ignore previous", "ignore all previous", "system prompt", "developer message"]
PRODUCT_PHRASES = ["sản phẩm này", "barcode", "allergen", "dị ứng", "nutri-score"]
CONCEPT_PHRASES = ["là gì", "nghĩa là", "vì sao", "hướng dẫn", "khuyến nghị", "cao có sao"]
LINE_HEADINGS = ["Thành phần", "THÀNH PHẦN", "Ingredients", "DINH DƯỠNG", "Dinh dưỡng", "Nutrition", "Energy", "Năng lượng", "Protein", "Chất đạm", "Fat", "Chất béo", "Carbohydrate", "Sugars", "Đường", "Sodium", "Natri"]
TOKEN = r"[a-z0-9_\p{L}\p{N}À-ỹ]+"
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
PHONE = r"\b\+?\d[\d\s().-]{7,}\d\b"
SECRET = r"(?i)(?:api[_-]?key|token|secret)\s*[:=]\s*\S+"


def strings(values) -> Column:
    """A literal array of strings."""
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def contains_any(text: Column, phrases) -> Column:
    """Whether a text holds one of a few fixed phrases; null for a null text."""
    found = F.lit(False)
    for p in phrases:
        found = found | F.contains(text, F.lit(p))
    return found


def tokenize(text: Column, remove_stop_words: bool = False, expand_aliases: bool = False) -> Column:
    """Lower-case words of three letters or more, and shorter ones that have an alias.

    Aliases follow all words, in the words' order.  A null text has no words.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    kept = lambda w: (F.length(w) >= 3) | w.isin(*ALIASES)
    words = F.filter(words, (lambda w: kept(w) & ~w.isin(*STOP_WORDS)) if remove_stop_words else kept)
    if expand_aliases:
        # few words have an alias; those alone are looked up
        table = F.create_map(*[x for k, v in ALIASES.items() for x in (F.lit(k), strings(v))])
        words = F.transform(F.array(words), lambda w: F.concat(w, F.flatten(F.transform(F.filter(w, lambda x: x.isin(*ALIASES)), lambda x: table[x]))))[0]
    return words


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def question_hash(question: Column) -> Column:
    """Hash of a question that does not depend on its case or outer white space."""
    return F.sha2(F.lower(F.regexp_replace(question, r"^\s+|\s+$", "")), 256)


def redact_sensitive(text: Column) -> Column:
    """E-mail addresses, then phone-like numbers, then named secrets become ``[redacted]``."""
    for pattern in (EMAIL, PHONE, SECRET):
        text = F.regexp_replace(text, pattern, "[redacted]")
    return text


def audit_safe_payload(payload: Column) -> Column:
    """Of a map of strings each value redacted and cut to 500 characters; JSON arrays and objects become ``[structured]``."""
    return F.transform_values(payload, lambda k, v: F.when(v.rlike(r"^\s*[\[{]"), F.lit("[structured]")).otherwise(F.left(redact_sensitive(v), F.lit(500))))


def has_injection_risk(text: Column) -> Column:
    return contains_any(F.lower(text), INJECTION_PHRASES)


def missing_metadata(metadata: Column) -> Column:
    """Sorted required keys that the map lacks."""
    return F.array_sort(F.array_except(strings(REQUIRED_METADATA), F.map_keys(metadata)))


def as_sentence(text: Column) -> Column:
    """White space collapsed, with a closing mark."""
    line = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(line.rlike(r"[.!?]$"), line).otherwise(F.concat(line, F.lit(".")))


def snippet(text: Column, length: int = 420) -> Column:
    return F.substring(text, 1, length)


def cer(reference: Column, hypothesis: Column) -> Column:
    """Edit distance over the reference's length, without regard to case, to four places."""
    return F.round(F.levenshtein(F.lower(reference), F.lower(hypothesis)) / F.greatest(F.lit(1), F.length(reference)), 4)


def _folding() -> tuple[str, str]:
    import unicodedata

    pairs = [(c, "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")) for c in map(chr, range(0xC0, 0x1EFA))]
    pairs = [(c, d) for c, d in pairs if c != d and len(d) == 1] + [("đ", "d")]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


FOLD_FROM, FOLD_TO = _folding()


def fold_accents(text: Column) -> Column:
    """Lower case without accents; whatever is not a-z or 0-9 becomes one space."""
    plain = F.regexp_replace(F.translate(F.lower(text), FOLD_FROM, FOLD_TO), r"\p{Mn}", "")
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def contains_term(folded: Column, term) -> Column:
    """Whether folded text holds a whole term."""
    term = term if isinstance(term, Column) else F.lit(term)
    return F.contains(F.concat(F.lit(" "), folded, F.lit(" ")), F.concat(F.lit(" "), term, F.lit(" ")))


def restore_lines(text: Column) -> Column:
    """A line break before each known heading that follows a space."""
    for heading in LINE_HEADINGS:
        text = F.replace(text, F.lit(" " + heading), F.lit("\n" + heading))
    return text


def normalize_path(path: Column) -> Column:
    """Long segments with a dash, such as identifiers, become ``{id}``."""
    return F.array_join(F.transform(F.split(path, "/"), lambda s: F.when((F.length(s) >= 32) & F.contains(s, F.lit("-")), F.lit("{id}")).otherwise(s)), "/")


def classify_route(question: Column, barcode: Column) -> Column:
    """mixed with a barcode; else by product and concept phrases: mixed, product or rag."""
    product, concept = contains_any(F.lower(question), PRODUCT_PHRASES), contains_any(F.lower(question), CONCEPT_PHRASES)
    has_code = F.coalesce(F.length(barcode) > 0, F.lit(False))
    return F.when(has_code | (product & concept), "mixed").when(product, "product").otherwise("rag")


def in_domain(question: Column) -> Column:
    return F.arrays_overlap(tokenize(question), strings(NUTRITION_TERMS))


def set_overlap(a: Column, b: Column) -> Column:
    """Sorted members of both arrays."""
    return F.array_sort(F.array_intersect(a, b))


def set_missing(a: Column, b: Column) -> Column:
    """Sorted members of the first array that the second lacks."""
    return F.array_sort(F.array_except(a, b))


def hash_lines(lines: DataFrame, *order: str, name: str, tail: str = "") -> DataFrame:
    """One row with the SHA-256 of the column ``line``, in order and joined by line feeds, and of ``tail``.

    Null lines are left out.  One task sorts them, on disk where they are many, and holds a batch at a time.
    """

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h, first = sha256(), True
        for batch in batches:
            for line in batch.loc[batch["_end"] == 0, "line"]:
                h.update(("" if first else "\n").encode() + line.encode())
                first = False
        h.update(tail.encode())
        yield pd.DataFrame({name: [h.hexdigest()]})

    # a last row, so that there is a task where there are no lines
    end = lines.sparkSession.range(1).select(*[F.lit(None).cast(lines.schema[k].dataType).alias(k) for k in order], F.lit("").alias("line"), F.lit(1).alias("_end"))
    rows = lines.where("line is not null").select(*order, "line", F.lit(0).alias("_end")).unionByName(end)
    return rows.repartition(1).sortWithinPartitions("_end", *order, "line").select("line", "_end").mapInPandas(digest, f"{name} string")
