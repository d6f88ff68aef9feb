"""Exact arithmetic on written numbers of any length: digits in limbs of six, least first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirelake.functions.text import let

LIMB, BASE = 6, 10**6
#: Digits of products that are reckoned in longs.
SHORT = 17


def _parts(number: Column) -> Column:
    """(negative, digits, scale) of a written number: its digits without the decimal mark, and how many stand behind it."""
    plain = F.translate(number, "−, ", "-.")
    body = F.regexp_replace(plain, "^[+-]", "")
    behind = F.when(F.contains(body, F.lit(".")), F.char_length(F.substring_index(body, ".", -1))).otherwise(F.lit(0))
    return F.struct(plain.startswith("-").alias("negative"), F.replace(body, F.lit("."), F.lit("")).alias("digits"), behind.alias("scale"))


def limbs(digits: Column) -> Column:
    """A string of digits as limbs."""
    n = F.ceil(F.char_length(digits) / LIMB).cast("int")
    return let(
        F.struct(F.lpad(digits, n * LIMB, "0").alias("d"), n.alias("n")),
        lambda s: F.transform(F.sequence(F.lit(1), s["n"]), lambda i: F.substring(s["d"], (s["n"] - i) * LIMB + 1, F.lit(LIMB)).cast("bigint")),
    )


def product(a: Column, b: Column) -> Column:
    """Limbs of a product, not yet carried over."""

    def limb(k: Column) -> Column:
        places = F.sequence(F.greatest(F.lit(0), k - F.size(b) + 1), F.least(k, F.size(a) - 1))
        return F.aggregate(places, F.lit(0).cast("bigint"), lambda s, i: s + F.get(a, i) * F.get(b, k - i))

    return F.transform(F.sequence(F.lit(0), F.size(a) + F.size(b) - 2), limb)


def is_positive(values: Column) -> Column:
    """Whether limbs of any sign, not carried over, stand for a number above zero."""
    state = "struct<carry:bigint,some:boolean>"

    def step(s: Column, x: Column) -> Column:
        total = s["carry"] + x
        low = F.pmod(total, F.lit(BASE))
        return F.struct(((total - low) / BASE).cast("bigint").alias("carry"), (s["some"] | (low != 0)).alias("some")).cast(state)

    start = F.struct(F.lit(0).cast("bigint").alias("carry"), F.lit(False).alias("some")).cast(state)
    return F.aggregate(values, start, step, lambda s: (s["carry"] > 0) | ((s["carry"] == 0) & s["some"]))


def product_misses(a: Column, b: Column, c: Column) -> Column:
    """Whether a times b is further from c than half a unit of c's last place; numbers as they are written, of any length."""

    def compare(x: Column) -> Column:
        digits = [F.char_length(x[n]["digits"]) for n in "abc"]
        return F.when((digits[0] + digits[1] + x["c"]["scale"] <= SHORT) & (digits[2] + x["a"]["scale"] + x["b"]["scale"] <= SHORT), short(x)).otherwise(long(x))

    def short(x: Column) -> Column:
        """All of it in longs: no power of ten that a side is multiplied by makes it longer than SHORT digits."""
        a, b, c = (x[n]["digits"].cast("bigint") for n in "abc")
        behind = x["c"]["scale"] - x["a"]["scale"] - x["b"]["scale"]
        ten = lambda n: F.concat(F.lit("1"), F.repeat(F.lit("0"), F.greatest(n, F.lit(0)))).cast("bigint")
        ours = F.when(x["a"]["negative"] == x["b"]["negative"], a).otherwise(-a) * b * ten(behind)
        theirs = F.when(x["c"]["negative"], -c).otherwise(c) * ten(-behind)
        return 2 * F.abs(ours - theirs) > ten(-behind)

    def long(x: Column) -> Column:
        together = x["a"]["scale"] + x["b"]["scale"]
        most = F.greatest(together, x["c"]["scale"])
        shifted = F.concat(x["a"]["digits"], F.repeat(F.lit("0"), most - together))
        found, unit = F.concat(x["c"]["digits"], F.repeat(F.lit("0"), most - x["c"]["scale"])), F.concat(F.lit("1"), F.repeat(F.lit("0"), most - x["c"]["scale"]))
        held = F.struct(product(limbs(shifted), limbs(x["b"]["digits"])).alias("p"), limbs(found).alias("c"), limbs(unit).alias("u"))
        sign = F.when(x["a"]["negative"] == x["b"]["negative"], F.lit(1)).otherwise(F.lit(-1)), F.when(x["c"]["negative"], F.lit(-1)).otherwise(F.lit(1))

        def beyond(v: Column, side: int) -> Column:
            """Above half a unit on one side: 2 (ab - c) - unit > 0, or with both terms negated."""
            n = F.greatest(F.size(v["p"]), F.size(v["c"]), F.size(v["u"]))
            at = lambda of, i: F.coalesce(F.get(of, i), F.lit(0))
            return is_positive(F.transform(F.sequence(F.lit(0), n - 1), lambda i: 2 * side * (sign[0] * at(v["p"], i) - sign[1] * at(v["c"], i)) - at(v["u"], i)))

        return let(held, lambda v: beyond(v, 1) | beyond(v, -1))

    return let(F.struct(_parts(a).alias("a"), _parts(b).alias("b"), _parts(c).alias("c")), compare)
