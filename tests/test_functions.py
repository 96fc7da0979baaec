"""Golden examples of normalisation, numbers and string kernels."""

import random

import pytest
from pyspark.sql import functions as F

from recolink.functions import kernels, numbers, text

NAMES = {
    "*** Springda1e City Of": {"name_clean": "springda1e city of", "name_core": "springdale city"},
    "3rd Eye 1947 Traders": {"name_core": "3rd eye 1947 traders"},
    "springdalecity.com #39256": {"name_clean": "springdalecity", "name_core": "springdalecity", "is_domain": True},
    "kimb1eolvas.com": {"name_core": "kimbleolvas"},
    "Kimble, Olva S., L.C.S.W., (PC)": {"name_clean": "kimble olva s lcsw"},
    "CARDIOLOGY SAFE CARE INC [INC]": {"name_core": "cardiology safe care", "legal_form": "INC"},
    "Fractales Amis Groupe S.A.S": {"legal_form": "SAS"},
    "Europ & Frères Distribution S.A.": {"name_core": "europ distribution", "legal_form": "FRERES|SA"},
    "Secunderabad-Easy  Private Limited": {"name_core": "secunderabad easy", "legal_form": "PRIVATE_LIMITED"},
    "Family Family Bright Health,": {"name_clean": "family bright health"},
    "Dr Al  Tech": {"name_core": "al tech"},
    "अल टेक प्राइवेट लिमिटेड": {"name_core": "al tek", "legal_form": "PRIVATE_LIMITED", "name_nonlatin": True},
    "अल टेक प्रा. लि.": {"legal_form": "PRIVATE_LIMITED"},
    "M/S. Special India Traders": {"name_core": "special india traders"},
    "M Sharma Traders": {"name_core": "m sharma traders"},
    "Hotel Constructions Public Ltd": {"name_core": "hotel constructions", "legal_form": "PUBLIC_LIMITED"},
    "Public Health Care Ltd": {"name_core": "public health care"},
    "Sharma Foods (Pvt) Ltd": {"name_core": "sharma foods", "legal_form": "PRIVATE_LIMITED"},
    "Heritage Semiconductor Union (Holdings)": {"name_core": "heritage semiconductor union", "legal_form": ""},
    "Engages Àrt Pharmacie SCI": {"name_core": "engages art pharmacie", "name_nonlatin": False},
    "The Company Ltd": {"name_core_fallback": True},
    "": {"name_core": "", "name_core_fallback": False},
}
ADDRESSES = {
    "607 VIRGINIA ST, PO BOX 2342, N/A, TERRELL, TX": ("607 virginia street, terrell, tx", ["607"], ["2342"]),
    "41 Chert Street, PMB 7452, Stephens": ("41 chert street, stephens", ["41"], ["7452"]),
    "# 45, 3rd Cross, Bangalore": ("45, 3rd cross, bangalore", ["45", "3"], []),
    "N° 10 RUE DES POISSONNIERS": ("no 10 rue des poissonniers", ["10"], []),
    "123 Main St Apt 4, Boston": ("123 main street apt 4, boston", ["123", "4"], []),
    "12 St Pierre, Lyon": ("12 saint pierre, lyon", ["12"], []),
    "S S Nagar, St No 8": ("ss nagar, st no 8", ["8"], []),
    "Dr Ambedkar Road, Pune": ("dr ambedkar road, pune", [], []),
    "18 R JEAN ZAY": ("18 rue jean zay", ["18"], []),
    "5 bis Rue Pierre Dignac": ("5 rue pierre dignac", ["5"], []),
    "CH.SAMBHAJI NAGAR, AURANGABAD": ("ch sambhaji nagar, aurangabad", [], []),
    "NULL, N/A": ("", [], []),
}


def test_names(spark):
    df = spark.createDataFrame([(k,) for k in NAMES], "raw string").withColumn("latin", kernels.romanised("raw"))
    for row in text.normalize_names(df, "raw", "latin").collect():
        for field, value in NAMES[row.raw].items():
            assert row[field] == value, (row.raw, field)


def test_addresses(spark):
    df = spark.createDataFrame([(k,) for k in [*ADDRESSES, "2007 Robyn Road", "007 ROBYN RD", "02007 Robyn Road"]], "raw string")
    for row in text.normalize_addresses(df, "raw").collect():
        if row.raw in ADDRESSES:
            assert (row.addr_clean, row.numbers, row.filler_numbers) == ADDRESSES[row.raw]
            assert row.addr_empty == (row.addr_clean == "")
        else:
            assert row.num_keys == ["007"]


def test_number_relations(spark):
    df = spark.createDataFrame([("2007", "007"), ("2417", "2412"), ("5", "5"), ("", "5"), (None, "1")], "a string, b string")
    a, b = text.strip_zeros(F.col("a")), text.strip_zeros(F.col("b"))
    assert [r[0] for r in df.select(numbers.num_relation(a, b)).collect()] == ["compatible", "conflict", "equal", "missing", "missing"]


def test_tags(spark):
    cases = {
        "908, 9th floor mercantile house, 15 kg marg, delhi": (["908", "15"], ["9"]),
        "431 millwood avenue, fl 0, wichita, ks": (["431"], ["0"]),
        "f 27, first floor, savitri market sector 018, noida": (["27", "18"], ["1"]),
        "8 2 293 82 a 646a, road no 36": (["8", "2", "293", "82", "646", "36"], []),
        "": ([], []),
    }
    df = spark.createDataFrame([(k,) for k in cases], "a string")
    assert {r.a: (r.t.street, r.t.floor) for r in df.select("a", numbers.tag_numbers(F.col("a")).alias("t")).collect()} == cases
    row = spark.createDataFrame([("3 main st, 90210",)], "a string").select(numbers.tag_numbers(F.col("a"), [5]).alias("t")).first()
    assert (row.t.street, row.t.postal) == (["3"], ["90210"])


def test_tagged_features(spark):
    pairs = [("2007 oak st, 3rd floor", "007 oak st, 4th floor"), ("37 elm st", "32 elm st"), ("", "5 x"), ("12 99 x", "99 12 x")]
    df = spark.createDataFrame(pairs, "q string, s string").select(numbers.tag_numbers(F.col("q")).alias("q"), numbers.tag_numbers(F.col("s")).alias("s"))
    got = df.select(*[v.alias(k) for k, v in numbers.tagged_features(F.col("q"), F.col("s")).items()]).toPandas()
    assert list(got.st_compat) == [1, 0, 0, 2] and list(got.st_conflict) == [0, 1, 0, 0]
    assert list(got.floor_conflict) == [1, 0, 0, 0] and list(got.q_no_number) == [0, 0, 1, 0]
    assert list(got.st_main_conflict) == [0, 1, 0, 1] and got.st_jaccard[3] == 1.0


def test_probabilities(spark):
    row = spark.range(1).select(
        numbers.temperature(F.lit(0.8), 1.0).alias("t"), numbers.poisson_cut(F.lit(0.5)).alias("p"), numbers.md5_int64(F.lit("x")).alias("m"), text.num_key(F.lit("2007")).alias("k")
    ).first()
    import hashlib

    assert row.t == pytest.approx(0.8) and sum(row.p) == pytest.approx(1) and row.k == "007"
    assert int(row.m) == int.from_bytes(hashlib.md5(b"x").digest()[:8], "little")


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_kernels():
    random.seed(4)
    for _ in range(2000):
        a, b = ("".join(random.choice("abc d") for _ in range(random.randint(0, 20))) for _ in "ab")
        assert kernels.lcs_length(a, b) == lcs(a, b)
    assert kernels.ratio("", "") == 100 and kernels.token_sort_ratio("b a", "a b") == 100
    assert kernels.token_set_ratio("acme foods", "acme foods ltd") == 100 and kernels.token_set_ratio("", "a") == 0
    assert kernels.jaro_winkler("martha", "marhta") == pytest.approx(0.9611111)
    assert kernels.extract_one("abc", ["abd", "abc"], 90) == ("abc", 100.0) and kernels.extract_one("abc", ["xyz"], 50) is None
    assert kernels.extra_words("acme holdings", "acme") == ["holdings"]
    assert kernels.align_tokens("snraij bank", "sunrise bank") == [("snraij", "sunrise")]
