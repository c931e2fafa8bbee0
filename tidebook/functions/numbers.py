"""Large numbers and periods as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Decimal digits of a limb, and hexadecimal digits that are taken at once: 10^9 * 2^28 fits 63 bits.
LIMB, STEP = 9, 7
_BASE = 10**LIMB


def decimal_of_hex(digits: Column, width: int = 64) -> Column:
    """The decimal digits of a number of up to `width` hexadecimal digits; null for other text.

    The number is kept as limbs of nine decimal digits, the lowest first. With each seven hexadecimal digits every limb is
    multiplied by 16^7 and carries to the next one.
    """
    chunks = -(-width // STEP)
    n = -(-int(width * 1.2042) // LIMB) + 1
    padded = F.lpad(digits, chunks * STEP, "0")
    parts = F.array(*(F.conv(F.substring(padded, 1 + STEP * k, STEP), 16, 10).cast("long") for k in range(chunks)))

    def times(limbs: Column, add: Column) -> Column:
        def step(acc: Column, limb: Column) -> Column:
            value = limb * F.lit(1 << (4 * STEP)) + acc["carry"]
            return F.struct(F.call_function("div", value, F.lit(_BASE)).alias("carry"), F.concat(acc["out"], F.array(value % _BASE)).alias("out"))

        start = F.struct(add.alias("carry"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(limbs, start, step, lambda acc: acc["out"])

    limbs = F.aggregate(parts, F.array(*(F.lit(0).cast("long") for _ in range(n))), times)
    text = F.array_join(F.transform(F.reverse(limbs), lambda x: F.lpad(x.cast("string"), LIMB, "0")), "")
    plain = F.regexp_replace(text, "^0+(?=.)", "")
    return F.when(digits.rlike(f"^[0-9A-Fa-f]{{1,{width}}}$"), plain)


def hex_to_long(text: Column) -> Column:
    """A small hexadecimal number, with or without 0x; null for other text."""
    digits = F.regexp_replace(text, "^0[xX]", "")
    return F.when(digits.rlike("^[0-9A-Fa-f]{1,15}$"), F.conv(digits, 16, 10).cast("long"))


def period_ms(text: Column) -> Column:
    """Milliseconds of a period of days such as 7d or 45d; a week where it cannot be read."""
    days = F.regexp_extract(text, r"^(\d{1,8})d$", 1)
    return F.coalesce(F.when(days != "", days.cast("long") * 86_400_000), F.lit(7 * 86_400_000))
