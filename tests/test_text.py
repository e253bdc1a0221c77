import random

import pytest
from pyspark.sql import functions as F

from quarrylink.functions import similarity as S
from quarrylink.functions import text as T

GOLDEN = [
    ("harbor alliance", "45 goff st, po box 4918, corning, ny", "alliance harbor", "45 corning goff ny street"),
    ("marthena mowrer, p.a.", "ar, 2703 55th street, rogers, unit apt 203", "marthena mowrer p", "2703 55th ar rogers street unit"),
    ("evangeline chase chase [invesco]", "13809 43rd ave, spokane, wa", "chase evangeline invesco", "13809 43rd avenue spokane wa"),
    ("ramos and benham fusion", "burrell, pa, 378 devinney hollow road", "benham fusion ramos", "378 burrell devinney hollow pa road"),
    ("ro atlantic galaxy inc", "2119 tipton street, seymour, in", "atlantic galaxy ro", "2119 in seymour street tipton"),
]


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column).first()[0]


@pytest.mark.parametrize("name, address, want_name, want_address", GOLDEN)
def test_golden_normalisation(spark, name, address, want_name, want_address):
    assert one(spark, T.clean_name("n", sort=True), n=name) == want_name
    assert one(spark, T.clean_address("a", sort=True), a=address) == want_address


def test_null_is_empty(spark):
    assert one(spark, T.clean_name("n"), n=None) == ""
    assert one(spark, T.assembled("n", "a"), n=None, a="  X　") == " | x"


def test_quirks_are_kept(spark):
    assert one(spark, T.squash_repeats(F.col("a")), a="1000 main") == "10 main"
    assert one(spark, T.drop_noise(F.col("a")), a="miami florida (id: 12)") == "miami"
    assert one(spark, T.drop_noise(F.col("a"), strict=True), a="miami florida suite #5") == "miami florida"


def test_domain(spark):
    assert one(spark, T.domain("u"), u="https://www.Example.com:80/a?b") == "example.com:80"
    assert one(spark, T.domain("u"), u="example.org/x") == "example.org"


def test_edit_distances():
    assert S.winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert S.winkler("", "a") == 0 and S.winkler("a", "a") == 1
    assert S.indel("kitten", "sitting") == pytest.approx(2 * 4 / 13)
    assert S.token_sort("b a", "a b") == 1 and S.token_set("a b", "a b c") == 1
    assert S.partial("abc", "xxabcxx") == 1


def test_number_match(spark):
    match = S.number_match(F.col("a"), F.col("b"))
    assert [one(spark, match, a=x, b=y) for x, y in (("1 a", "1 b"), ("1 a", "2 b"), ("a", "2 b"), ("a", "b"))] == [1, 0, 0.5, 1]


def test_partial_ratio_against_all_stretches():
    rng = random.Random(3)
    for _ in range(2000):
        a, b = ("".join(rng.choices(letters, k=rng.randint(0, 12))) for letters in ("abc ", "abcd "))
        short, long = sorted((a, b), key=len)
        want = [S.indel(short, long[max(0, i) : i + len(short)]) for i in range(1 - len(short), len(long))]
        assert S.partial(a, b) == (max(want) if short else 0)
