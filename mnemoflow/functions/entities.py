"""Entity extraction as a chain of column expressions: no Python in the path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import canon, sentences, strip, words
from .wordlists import MONTHS, NAME_LINKS, SENTENCE_STARTERS, SHORT_MONTHS, STOPWORDS

_FULL_MONTHS = "|".join(sorted(MONTHS + SHORT_MONTHS, key=len, reverse=True))
URL = r"(?U)https?://\S+"
EMAIL = r"(?U)[\w.+-]+@[\w-]+\.[\w.-]+"
ISO_DATE = r"(?U)\b\d{4}-\d{2}-\d{2}\b"
MONTH_DAY = rf"(?U)\b(?:{_FULL_MONTHS})\.?\s+\d{{1,2}}(?:st|nd|rd|th)?(?:,?\s+\d{{4}})?\b"
DAY_MONTH = rf"(?U)\b\d{{1,2}}(?:st|nd|rd|th)?\s+(?:{_FULL_MONTHS})\.?(?:\s+\d{{4}})?\b"
MONTH_YEAR = rf"(?U)\b(?:{_FULL_MONTHS})\.?\s+\d{{4}}\b"
YEAR = r"(?U)\b(?:20|19)\d{2}\b"
NUMBER = r"(?U)[€£$]?\b\d+(?:[.,]\d+)*%?"
QUOTE = r"\x22([^\x22]{2,120})\x22"
_CODE_LIKE = r"^-|&&|\$\(|`|\{|\}|\\|--"
_ALNUM = r"\p{IsAlphabetic}\p{N}"
_CAP = rf"\p{{Lu}}[{_ALNUM}'.\-]*"
_LINKS = "|".join(NAME_LINKS)
_SPAN = rf"(\x01? {_CAP} (?: {_CAP} | (?:{_LINKS})  {_CAP} )*)"
KINDS = ("Named", "Date", "Number", "Quote", "Url", "Email")
_TYPE = "array<struct<display:string,canon:string,kind:string>>"


def _entities(found: Column, kind: str) -> Column:
    return F.transform(found, lambda d: F.struct(strip(d).alias("display"), canon(d).alias("canon"), F.lit(kind).alias("kind")))


def mask_code(c: Column) -> Column:
    """Fenced and inline code replaced by a space."""
    return F.regexp_replace(F.regexp_replace(c, r"(?s)```.*?```", " "), r"`[^`\n]+`", " ")


def _all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def _noise(w: Column) -> Column:
    return F.lower(w).isin(STOPWORDS + SENTENCE_STARTERS)


def capitalized_spans(sentence: Column) -> Column:
    """Runs of capitalised words of a sentence, over at most one connecting word at a time.

    Words are padded with spaces on both sides and the sentence is led by U+0001, so one regular expression finds the
    runs and a match tells whether it begins the sentence.
    """
    trimmed = F.transform(words(sentence), lambda w: F.concat(F.lit(" "), F.regexp_replace(w, rf"^[^{_ALNUM}'.\-]+|[^{_ALNUM}'.\-]+$", ""), F.lit(" ")))
    padded = F.concat(F.lit("\x01"), F.array_join(trimmed, ""))
    spans = F.transform(_all(padded, _SPAN, 1), lambda m: F.struct(m.startswith("\x01").alias("first"), F.filter(F.split(F.regexp_replace(m, "\x01", ""), " +"), lambda w: w != "").alias("w")))

    def keep(s: Column) -> Column:
        alone = s["first"] & (F.size(s["w"]) == 1)
        head = F.get(s["w"], F.lit(0))
        return F.when(alone, ~_noise(head) & (F.octet_length(head) > 2)).otherwise(F.exists(s["w"], lambda w: ~_noise(w)))

    kept = F.transform(F.filter(spans, keep), lambda s: F.regexp_replace(F.array_join(s["w"], " "), r"\.+$", ""))
    return F.filter(kept, lambda d: d != "")


def with_entities(df, text: str = "text", out: str = "entities"):
    """``df`` with a column of the text's entities, in the order in which the passes find them.

    Each pass works on what the passes before left: links, addresses and ISO dates are searched in the code-free text,
    other dates and numbers with those masked, names sentence by sentence in what is left; quotes keep their inside.
    """
    df = df.withColumn("_c", mask_code(F.col(text)))
    masked = F.col("_c")
    for p in (URL, EMAIL, ISO_DATE):
        masked = F.regexp_replace(masked, p, " ")
    df = df.withColumn("_m0", masked)
    for i, p in enumerate((MONTH_DAY, DAY_MONTH, MONTH_YEAR, YEAR)):
        df = df.withColumn(f"_m{i + 1}", F.regexp_replace(f"_m{i}", p, " "))
    number = F.filter(_all(F.col("_m4"), NUMBER), lambda s: (F.octet_length(s) > 1) | (F.coalesce(s.try_cast("int"), F.lit(0)) > 1))
    quote = F.filter(_all(F.col("_c"), QUOTE, 1), lambda q: q.rlike(r"\p{IsAlphabetic}") & ~q.rlike(_CODE_LIKE))
    names = F.flatten(F.transform(sentences(F.col("_m4")), capitalized_spans))
    found = F.concat(
        _entities(_all(F.col("_c"), URL), "Url"),
        _entities(_all(F.col("_c"), EMAIL), "Email"),
        _entities(_all(F.col("_c"), ISO_DATE), "Date"),
        *[_entities(_all(F.col(f"_m{i}"), p), "Date") for i, p in enumerate((MONTH_DAY, DAY_MONTH, MONTH_YEAR, YEAR))],
        _entities(number, "Number"),
        _entities(quote, "Quote"),
        _entities(names, "Named"),
    )
    return df.withColumn(out, F.coalesce(found, F.array().cast(_TYPE))).drop("_c", *[f"_m{i}" for i in range(5)])
