"""Scalar text functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and patterns of the rules below, and sensitive keys.
SIMPLE_STARTS = (
    r"^你好|^hi|^hello|^hey",
    r"^谢谢|^thanks|^thank you",
    r"^再见|^bye|^goodbye",
    r"^是的|^no|^没错|^正确",
)
COMPLEX_WORDS = (
    "分析", "比较", "评估", "解释", "总结", "推理", "论证",
    "analyze", "compare", "evaluate", "explain", "summarize", "reasoning",
    "为什么", "how", "why", "what if", "如果",
)
LEVELS = {
    "RESTRICTED": (r"\b\d{18}\b", r"\b\d{16,19}\b", r"password|secret|token|key"),
    "CONFIDENTIAL": (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", r"\b1[3-9]\d{9}\b", r"location|address|coordinate"),
    "INTERNAL": (r"entity|relation|memory|note",),
}
SENSITIVE_KEYS = ("password", "token", "secret", "credit_card", "ssn", "phone", "email", "location", "address")
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def language(text: Column, share: float = 0.3) -> Column:
    """zh if more than ``share`` of the characters that are no space are Han, else en."""
    han = F.regexp_count(text, F.lit(r"[\x{4e00}-\x{9fff}]"))
    rest = F.length(F.replace(text, F.lit(" "), F.lit("")))
    return F.when(F.try_divide(han, rest) > share, "zh").otherwise("en")


def complexity(text: Column) -> Column:
    """SIMPLE, MODERATE or COMPLEX by how a text starts, its length, telling words and question marks or commas."""
    low = F.lower(text)
    score = reduce(lambda a, b: a + b, (low.contains(w).cast("int") for w in COMPLEX_WORDS))
    marks = F.regexp_count(text, F.lit("[?？,]"))
    n = F.length(text)
    return (
        F.when(low.rlike("|".join(SIMPLE_STARTS)) | (n < 20), "SIMPLE")
        .when((score >= 2) | (marks >= 2) | (n > 200), "COMPLEX")
        .when((score >= 1) | (n > 100), "MODERATE")
        .otherwise("SIMPLE")
    )


def classification(text: Column) -> Column:
    """The first protection level one of whose patterns occurs, else PUBLIC."""
    out = F.when(F.lit(False), "")
    for level, patterns in LEVELS.items():
        out = out.when(F.lower(text).rlike("|".join(patterns)), level)
    return out.otherwise("PUBLIC")


def without_tags(text: Column) -> Column:
    """Tags become spaces, runs of white space one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", " "), r"\s+", " "))


def emails(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"({EMAIL})")))


def anonymous(value: Column) -> Column:
    return F.substring(F.sha2(value.cast("string"), 256), 1, 16)


def masked_email(address: Column) -> Column:
    """First and last letter of the local part stay; a local part of at most two is all stars."""
    local, domain = F.substring_index(address, "@", 1), F.substring_index(address, "@", -1)
    n = F.length(local)
    stars = F.when(n <= 2, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(local, 1, 1), F.repeat(F.lit("*"), n - 2), F.right(local, F.lit(1))))
    return F.concat(stars, F.lit("@"), domain)


def masked_mobile(number: Column) -> Column:
    """Three digits stay at either end."""
    return F.concat(F.substring(number, 1, 3), F.repeat(F.lit("*"), F.length(number) - 6), F.right(number, F.lit(3)))


def redacted(pairs: Column) -> Column:
    """A map with the values of sensitive keys replaced."""
    return F.transform_values(pairs, lambda k, v: F.when(F.lower(k).rlike("|".join(SENSITIVE_KEYS)), "***REDACTED***").otherwise(v))


def title(text: Column, most: int = 50) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def concept_id(kind: Column, label: Column) -> Column:
    return F.concat(F.lower(kind), F.lit("_"), F.substring(F.md5(label), 1, 8))
