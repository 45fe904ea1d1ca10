"""Reading of content and perceptual hashes, and Hamming distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks of the data model.
BLANKS = " \t\r"


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def name_key(c: Column) -> Column:
    """Trimmed, lower-case name; an empty one is null."""
    return F.nullif(F.lower(trimmed(c)), F.lit(""))


def video_key(c: Column) -> Column:
    """Last piece of a path, trimmed and in lower case; null if nothing is left."""
    return name_key(F.substring_index(c, "/", -1))


def sha_key(c: Column) -> Column:
    """SHA text without a ``sha256:`` prefix; null if empty."""
    return F.nullif(F.regexp_replace(F.lower(trimmed(c)), "^sha256:", ""), F.lit(""))


def hash64(c: Column) -> Column:
    """A hexadecimal number of 1 to 16 digits as a signed 64-bit value; zero and anything else is null."""
    # Zero has no first digit after its zeros, so that it fails to match like other unusable texts.
    digits = F.regexp_extract(F.lower(trimmed(c)), "^(?:0x)?(?=[0-9a-f]{1,16}$)0*([1-9a-f][0-9a-f]*)$", 1)
    return F.conv(digits, 16, -10).cast("bigint")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
