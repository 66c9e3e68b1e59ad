"""Fields of the six-bit armoured message payload, by the public bit layout of ITU-R M.1371.

The armour is base64 with another alphabet, so a payload turns into hexadecimal text with built-in
functions, and each field is read from the few digits that hold it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The 64 payload characters in order of their value, the same for base64.
ARMOUR = "".join(map(chr, [*range(48, 88), *range(96, 120)]))
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
# The 64 characters of text fields in order of their value.
TEXT = "".join(map(chr, [*range(64, 96), *range(32, 64)]))
VALID_PAYLOAD = r"^[0-W`-w]+$"


def with_bits(messages: DataFrame) -> DataFrame:
    """Adds ``_hex`` and ``_bits`` (number of payload bits), dropping undecodable payloads."""
    padded = F.rpad("payload", (F.ceil(F.length("payload") / 4) * 4).cast("int"), F.lit("0"))
    return (
        messages.filter(F.col("payload").rlike(VALID_PAYLOAD))
        .withColumn("_bits", F.length("payload") * 6)
        .withColumn("_hex", F.hex(F.unbase64(F.translate(padded, ARMOUR, BASE64))))
    )


def _digits(start: int, width: int) -> Column:
    """Number held by ``width`` hexadecimal digits from a 0-based digit on."""
    return F.conv(F.substring("_hex", start + 1, width), 16, 10).try_cast("bigint")


def unsigned(start: int, bits: int) -> Column:
    """Unsigned integer field; null if the payload ends before it."""
    first, last = start // 4, (start + bits - 1) // 4
    surplus = 4 * (last + 1) - (start + bits)
    value = F.shiftright(_digits(first, last - first + 1), surplus).bitwiseAND(F.lit((1 << bits) - 1))
    return F.when(F.col("_bits") >= start + bits, value)


def signed(start: int, bits: int) -> Column:
    value = unsigned(start, bits)
    return F.when(value >= 1 << (bits - 1), value - (1 << bits)).otherwise(value)


def text(start: int, chars: int) -> Column:
    """Text field of six-bit characters; characters behind the end of the payload are left out.

    Eight characters at a time are moved to a place of their own, and all turn into text by one translation.
    """
    steps = []
    for begin in range(start, start + chars * 6, 48):
        first, last = begin // 4, (begin + 47) // 4
        digits = F.substring(F.rpad("_hex", last + 1, F.lit("0")), first + 1, last - first + 1)
        if begin % 4:
            value = F.shiftright(F.conv(digits, 16, 10).cast("bigint"), 4 * (last + 1) - (begin + 48))
            digits = F.lpad(F.hex(value.bitwiseAND(F.lit((1 << 48) - 1))), 12, "0")
        steps.append(digits)
    letters = F.translate(F.base64(F.unhex(F.concat(*steps))), BASE64, TEXT)
    there = F.floor((F.col("_bits") - start) / 6).cast("int")
    return F.substring(letters, F.lit(1), F.greatest(F.least(there, F.lit(chars)), F.lit(0)))
