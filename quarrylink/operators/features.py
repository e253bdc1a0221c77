"""Pair features.  Input: pairs with q_/c_ name, address and country columns next to the ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylink.functions import similarity as S
from quarrylink.functions import text as T

PIPELINE = ["hvt_rank", "hvt_cosine_score", "name_jaro_winkler", "name_token_sort", "name_jaccard", "addr_jaro_winkler", "addr_token_sort", "addr_jaccard", "exact_name_match", "country_match", "name_word_count_diff", "addr_word_count_diff", "address_numbers_match"]
WIDE = [*PIPELINE, "name_token_set", "name_partial_ratio", "name_levenshtein_ratio", "name_3gram_jaccard", "name_prefix_match", "exact_addr_match"]
KEYS = ["query_id", "candidate_id"]


def attach(pairs: DataFrame, queries: DataFrame, corpus: DataFrame, id_col: str = "entity_id") -> DataFrame:
    """Pairs with both records' columns, as q_* and c_*; pairs with an unknown id fall away."""
    q = queries.select(F.col(id_col).alias("query_id"), *[F.col(c).alias(f"q_{c}") for c in queries.columns if c != id_col])
    c = corpus.select(F.col(id_col).alias("candidate_id"), *[F.col(x).alias(f"c_{x}") for x in corpus.columns if x != id_col])
    return pairs.join(q, "query_id").join(c, "candidate_id")


def native(pairs: DataFrame, name: str = "name_lex", address: str = "addr_lex") -> DataFrame:
    """The features that need no Python."""
    qn, cn, qa, ca = (F.col(x) for x in (f"q_{name}", f"c_{name}", f"q_{address}", f"c_{address}"))
    return pairs.withColumns({
        "name_jaccard": S.token_jaccard(qn, cn),
        "addr_jaccard": S.token_jaccard(qa, ca),
        "name_3gram_jaccard": S.char_jaccard(qn, cn),
        "exact_name_match": S.exact(qn, cn),
        "exact_addr_match": S.exact(qa, ca),
        "country_match": S.same_country(F.col("q_country"), F.col("c_country")),
        "name_word_count_diff": S.count_difference(qn, cn),
        "addr_word_count_diff": S.count_difference(qa, ca),
        "address_numbers_match": S.number_match(qa, ca),
        "name_prefix_match": S.same_prefix(qn, cn),
    })


def wide(pairs: DataFrame, name: str = "name_lex", address: str = "addr_lex") -> DataFrame:
    """All 19 model inputs, after the top-k."""
    qn, cn, qa, ca = (F.col(x) for x in (f"q_{name}", f"c_{name}", f"q_{address}", f"c_{address}"))
    ready = native(pairs.withColumnsRenamed({"rank": "hvt_rank", "score": "hvt_cosine_score"}), name, address)
    return ready.withColumns({
        "name_jaro_winkler": S.jaro_winkler(qn, cn),
        "addr_jaro_winkler": S.jaro_winkler(qa, ca),
        "name_token_sort": S.token_sort_ratio(qn, cn),
        "addr_token_sort": S.token_sort_ratio(qa, ca),
        "name_token_set": S.token_set_ratio(qn, cn),
        "name_partial_ratio": S.partial_ratio(qn, cn),
        "name_levenshtein_ratio": S.indel_ratio(qn, cn),
    })


def pipeline(pairs: DataFrame, name: str = "name_lex", address: str = "addr_lex") -> DataFrame:
    return wide(pairs, name, address).drop(*[c for c in WIDE if c not in PIPELINE])


def meta(pairs: DataFrame, ce_score: str = "ce_score", name: str = "business_name", address: str = "business_address") -> DataFrame:
    """The 14 inputs of the tiered scorer, with signed and neutral values."""
    # Columns of their own: a Python function cannot stand inside a lambda.
    plain = {f"_{x}": F.lower(F.trim(T.to_ascii(T.text_or_empty(x)))) for x in (f"q_{name}", f"c_{name}", f"q_{address}", f"c_{address}")}
    pairs = pairs.withColumns(plain)
    an, bn, aa, ba = map(F.col, plain)
    no_q, no_c = T.missing_address(f"q_{address}"), T.missing_address(f"c_{address}")
    ce = F.col(ce_score)
    out = pairs.withColumns({
        "name_jw": S.jaro_winkler_ungated(an, bn),
        "name_tsr": S.bigram_token_sort(an, bn),
        "legal_suffix_match": S.signed_overlap(T.legal_suffixes(an), T.legal_suffixes(bn)),
        "addr_jw": F.when(no_q | no_c, 0.5).otherwise(S.jaro_winkler_ungated(aa, ba)),
        "addr_tsr": F.when(no_q | no_c, 0.5).otherwise(S.bigram_token_sort(aa, ba)),
        "q_addr_missing": no_q.cast("double"),
        "c_addr_missing": no_c.cast("double"),
        "street_num_match": S.signed_overlap(S.street_numbers(aa), S.street_numbers(ba)),
        "country_match": F.when(F.lower(F.trim(T.text_or_empty("q_country"))) == F.lower(F.trim(T.text_or_empty("c_country"))), 1.0).otherwise(-1.0),
    })
    return out.withColumns({
        "ce_x_name_jw": ce * F.col("name_jw"),
        "ce_x_addr_jw": ce * F.col("addr_jw"),
        "name_x_addr": F.col("name_jw") * F.col("addr_jw"),
        "ce_x_street": ce * F.when(F.col("street_num_match") == 1, 1.0).otherwise(0.5),
    }).drop(*plain)


def vetoed(q_address: str, c_address: str, q_country: str, c_country: str):
    """TRUE where both countries are known and differ, or both addresses hold street numbers and share none."""
    country = S.signed_country(F.col(q_country), F.col(c_country)) == -1
    street = S.signed_overlap(S.street_numbers(T.text_or_empty(q_address)), S.street_numbers(T.text_or_empty(c_address))) == -1
    return country | street
