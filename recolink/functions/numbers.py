"""Functions of house numbers, probabilities and hashes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words for a floor, and ordinals in words.
FLOOR_WORDS = ["floor", "flr", "fl", "floors"]
ORDINALS = {
    "ground": "0", "gr": "0", "grd": "0", "first": "1", "second": "2", "third": "3", "fourth": "4", "fifth": "5",
    "sixth": "6", "seventh": "7", "eighth": "8", "ninth": "9", "tenth": "10",
}


def main_number(numbers: Column) -> Column:
    return F.regexp_replace(F.get(numbers, F.lit(0)), "^0+(?!$)", "")


def num_match(a: Column, b: Column) -> Column:
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def compatible(a: Column, b: Column) -> Column:
    """Equal, or one begins or ends the other."""
    return (a == b) | a.startswith(b) | a.endswith(b) | b.startswith(a) | b.endswith(a)


def num_relation(a: Column, b: Column) -> Column:
    """missing, equal, compatible or conflict."""
    missing = a.isNull() | b.isNull() | (a == "") | (b == "")
    return F.when(missing, "missing").when(a == b, "equal").when(compatible(a, b), "compatible").otherwise("conflict")


def number_features(q: Column, s: Column) -> dict[str, Column]:
    a, b = main_number(q), main_number(s)
    relation = num_relation(a, b)
    value = lambda x: F.substring(x, 1, 12).cast("bigint")
    known = relation != "missing"
    absent = lambda x: (F.coalesce(x, F.lit("")) == "").cast("int")
    return {
        "num_equal": (relation == "equal").cast("int"),
        "num_compatible": relation.isin("equal", "compatible").cast("int"),
        "num_conflict": (relation == "conflict").cast("int"),
        "num_missing": (absent(a) + absent(b)).cast("int"),
        "num_edit": F.when(known, F.levenshtein(a, b)),
        "num_logdiff": F.when(known, F.log1p(F.abs(value(a) - value(b)).cast("double"))),
        "any_shared_number": F.arrays_overlap(q, s).cast("int"),
    }


def tag_numbers(address: Column, postal_lengths: list[int] | None = None) -> Column:
    """struct(street, floor, postal): number lists of a clean address, zeros stripped, in order of first sight."""
    strip = lambda x: F.regexp_replace(x, "^0+(?!$)", "")
    lookup = F.create_map(*[F.lit(x) for pair in ORDINALS.items() for x in pair])
    parts = F.filter(F.split(address, ","), lambda c: F.trim(c) != "")

    def tagged(part: Column, ci: Column) -> Column:
        toks = F.filter(F.split(F.trim(part), r"\s+"), lambda t: t != "")

        def one(t: Column, i: Column) -> Column:
            floor = F.coalesce(F.get(toks, i - 1).isin(FLOOR_WORDS), F.lit(False)) | F.coalesce(F.get(toks, i + 1).isin(FLOOR_WORDS), F.lit(False))
            last = (ci == F.size(parts) - 1) & (i == F.size(toks) - 1)
            postal = last & F.length(t).isin(postal_lengths) if postal_lengths else F.lit(False)
            entry = lambda kind, value: F.array(F.struct(F.lit(kind).alias("kind"), value.alias("value")))
            ordinal = F.regexp_extract(t, r"^(\d+)(?:st|nd|rd|th)$", 1)
            return (
                F.when(ordinal != "", entry("floor", strip(ordinal)))
                .when(t.isin(list(ORDINALS)) & floor, entry("floor", F.element_at(lookup, t)))
                .when(t.rlike("^[0-9]+$") & floor, entry("floor", strip(t)))
                .when(t.rlike("^[0-9]+$") & postal, entry("postal", strip(t)))
                .otherwise(F.transform(F.regexp_extract_all(t, F.lit(r"\d+"), F.lit(0)), lambda d: F.struct(F.lit("street").alias("kind"), strip(d).alias("value"))))
            )

        return F.flatten(F.transform(toks, one))

    found = F.flatten(F.transform(parts, tagged))
    of = lambda kind: F.array_distinct(F.transform(F.filter(found, lambda x: x["kind"] == kind), lambda x: x["value"]))
    return F.struct(of("street").alias("street"), of("floor").alias("floor"), of("postal").alias("postal"))


def tagged_features(q: Column, s: Column) -> dict[str, Column]:
    """Features of two tag_numbers structs."""
    qs, ss = q["street"], s["street"]
    both = (F.size(qs) > 0) & (F.size(ss) > 0)
    fits = lambda xs, ys: F.size(F.filter(xs, lambda a: F.exists(ys, lambda b: compatible(a, b))))
    first = num_relation(F.get(qs, F.lit(0)), F.get(ss, F.lit(0)))
    sets = lambda kind: (F.size(q[kind]) > 0) & (F.size(s[kind]) > 0)
    out = {
        "st_compat": F.when(both, fits(qs, ss)).otherwise(0),
        "st_conflict": F.when(both, F.size(qs) - fits(qs, ss)).otherwise(0),
        "st_conflict_s1": F.when(both, F.size(ss) - fits(ss, qs)).otherwise(0),
        "st_jaccard": F.when(both, F.size(F.array_intersect(qs, ss)) / F.size(F.array_union(qs, ss))),
        "st_main_equal": (both & (first == "equal")).cast("int"),
        "st_main_compat": (both & first.isin("equal", "compatible")).cast("int"),
        "st_main_conflict": (both & (first == "conflict")).cast("int"),
        "q_no_number": (F.size(qs) == 0).cast("int"),
        "s1_no_number": (F.size(ss) == 0).cast("int"),
        "n_street_q": F.size(qs),
        "n_street_s1": F.size(ss),
    }
    for kind in ("floor", "postal"):
        out[f"{kind}_equal"] = (sets(kind) & F.arrays_overlap(q[kind], s[kind])).cast("int")
        out[f"{kind}_conflict"] = (sets(kind) & ~F.arrays_overlap(q[kind], s[kind])).cast("int")
    return out


def temperature(p: Column, t: float) -> Column:
    """A probability with its logit divided by t."""
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return 1 / (1 + F.exp(-F.log(q / (1 - q)) / t))


def poisson_cut(rate: Column, most: int = 4) -> Column:
    """Probabilities of 0..most of a Poisson variable, scaled to sum to one."""
    mass = F.array(*[F.exp(-rate) * F.pow(rate, F.lit(k)) / F.factorial(F.lit(k)).cast("double") for k in range(most + 1)])
    return F.transform(mass, lambda x: x / F.aggregate(mass, F.lit(0.0), lambda a, b: a + b))


def md5_int64(text: Column) -> Column:
    """The first eight bytes of the MD5 digest as a little-endian unsigned integer."""
    pairs = F.regexp_extract_all(F.substring(F.md5(text), 1, 16), F.lit(".."), F.lit(0))
    return F.conv(F.array_join(F.reverse(pairs), ""), 16, 10).cast("decimal(20,0)")


def in_share(ident: Column, share: float) -> Column:
    """A fixed sample: the crc32 of the id, in millionths, under the share."""
    return F.crc32(ident) % 1_000_000 < int(share * 1_000_000)


def shard(ident: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(ident), F.lit(n)).cast("int")


def decoded(ident: Column, per_source: int = 10**8) -> tuple[Column, Column]:
    """source and row of an id that is source * per_source + row."""
    return F.floor(ident / per_source).alias("source"), F.pmod(ident, F.lit(per_source)).alias("row")
