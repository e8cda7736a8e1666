"""Scalar expressions."""
from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap_u32(c: Column) -> Column:
    """c modulo 2^32, as an unsigned 32-bit accumulator holds it."""
    return c.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))
