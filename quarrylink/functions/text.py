"""Text normalisation as column expressions.  A null text is the empty text everywhere."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values of the normaliser: legal forms, abbreviations, plurals, stop words and unit words, in order.
LEGAL_FORMS = [r"inc\b\.?", r"llc\b\.?", r"l\.l\.c\.\b", r"ltd\b\.?", r"limited\b", r"corp\b\.?", r"corporation\b", r"co\b\.?", r"company\b", r"plc\b\.?", r"gmbh\b", r"sa\b", r"nv\b", r"bv\b", r"srl\b", r"spa\b"]
BUSINESS_WORDS = {"mfg": "manufacturing", "mgmt": "management", "intl": "international", "grp": "group", "assoc": "associates", "tech": "technology", "bros": "brothers", "ctr": "center"}
ADDRESS_WORDS = {"st": "street", "ave": "avenue", "rd": "road", "blvd": "boulevard", "dr": "drive", "ln": "lane", "ct": "court", "pl": "place", "sq": "square", "ste": "suite", "apt": "apartment", "pkwy": "parkway", "hwy": "highway"}
PLURALS = {"services": "service", "partners": "partner", "holdings": "holding", "stores": "store", "centers": "center"}
STOP_WORDS = ["the", "and", "&", "of", "for", "in", "at", "on", "a", "an"]
UNIT_WORDS = r"po box|p\.o\. box|pmb|suite|ste|floor|fl|room|rm|apt"
SUFFIX_TOKENS = "ltd limited llc inc corp corporation pvt private co company plc gmbh sa srl bv ag pty lp llp pllc pc services solutions enterprises group".split()


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip_unicode(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def fold_space(c: Column) -> Column:
    """Lower case, white space squeezed to one space, ends stripped."""
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def drop_punctuation(c: Column) -> Column:
    return squeeze(F.regexp_replace(c, r"[^\p{L}\p{N}_\s]", " "))


def strip_legal_forms(c: Column) -> Column:
    for form in LEGAL_FORMS:
        c = F.regexp_replace(c, rf"(?iU)\b{form}", "")
    return squeeze(c)


def replace_words(c: Column, words: dict[str, str], dot: str = r"\.?") -> Column:
    for short, long in words.items():
        c = F.regexp_replace(c, rf"(?iU)\b{short}\b{dot}", long)
    return c


def expand_business(c: Column) -> Column:
    return replace_words(c, BUSINESS_WORDS)


def expand_address(c: Column) -> Column:
    return replace_words(c, ADDRESS_WORDS)


def singular(c: Column) -> Column:
    return replace_words(c, PLURALS, "")


def strip_zeros(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\b0+(\d+)\b", "$1")


def drop_noise(c: Column, strict: bool = False) -> Column:
    """Ids in brackets and unit designators with their value; ``strict`` asks for a space or # before the value."""
    c = F.regexp_replace(c, r"(?iU)\(?id:\s*\d+\)?", "")
    between = r"(?:\s+#?|#)" if strict else r"\s*#?"
    return squeeze(F.regexp_replace(c, rf"(?iU)\b(?:{UNIT_WORDS}){between}\w+\b", ""))


def squash_repeats(c: Column) -> Column:
    return F.regexp_replace(c, r"(.)\1{2,}", "$1")


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda x: x != "")


def drop_stop_words(c: Column) -> Column:
    return F.array_join(F.filter(tokens(c), lambda x: ~x.isin(STOP_WORDS)), " ")


def distinct_tokens(c: Column) -> Column:
    return F.array_join(F.array_distinct(tokens(c)), " ")


def sort_tokens(c: Column) -> Column:
    return F.array_join(F.array_sort(tokens(c)), " ")


def token_count(c: Column) -> Column:
    return F.size(tokens(c))


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@F.pandas_udf(StringType())
def to_ascii(texts: pd.Series) -> pd.Series:
    """Compatibility decomposition without marks; letters with no Latin base are dropped."""
    return texts.map(lambda x: unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode(), na_action="ignore")


def chain(c: Column, *steps: Callable[[Column], Column]) -> Column:
    for step in steps:
        c = step(c)
    return c


def clean_name(c: Column | str, sort: bool = False, unicode: bool = True) -> Column:
    first = [nfkc] if unicode else []
    steps = [*first, fold_space, drop_noise, strip_legal_forms, expand_business, singular, squash_repeats, drop_punctuation, strip_zeros, drop_stop_words, distinct_tokens]
    return chain(text_or_empty(c), *steps, *([sort_tokens] if sort else []))


def clean_address(c: Column | str, sort: bool = False, unicode: bool = True, expand: bool = True) -> Column:
    first = [nfkc] if unicode else []
    steps = [*first, fold_space, drop_noise, *([expand_address] if expand else []), squash_repeats, drop_punctuation, strip_zeros, distinct_tokens]
    return chain(text_or_empty(c), *steps, *([sort_tokens] if sort else []))


def domain(c: Column | str) -> Column:
    """Lower-case authority of a URL without www."""
    url = F.lower(F.trim(text_or_empty(c)))
    rest = F.regexp_replace(url, r"^[a-z][a-z0-9+.-]*://", "")
    return F.regexp_replace(F.regexp_extract(rest, r"^([^/?#]*)", 1), r"^www\.", "")


def phone_digits(c: Column | str) -> Column:
    return F.regexp_replace(text_or_empty(c), r"\D", "")


def legal_suffixes(c: Column) -> Column:
    words = tokens(squeeze(F.regexp_replace(F.lower(c), r"\.", "")))
    return F.array_intersect(words, F.array(*[F.lit(x) for x in SUFFIX_TOKENS]))


def missing_address(c: Column | str) -> Column:
    return F.lower(F.trim(text_or_empty(c))).isin("", "nan", "none", "na", "n/a")


def is_non_ascii(c: Column) -> Column:
    return c.rlike(r"[^\x00-\x7F]")


def assembled(*columns: str, separator: str = " | ") -> Column:
    """The columns, each lower-cased and stripped, null as empty, joined."""
    return F.concat_ws(separator, *[strip_unicode(F.lower(text_or_empty(c))) for c in columns])
