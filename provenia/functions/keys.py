"""Content keys."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def pages_key(pages: Column) -> Column:
    """SHA-256 of an array of binary pages, one after the other."""
    return F.sha2(F.aggregate(pages, F.lit(b""), lambda a, p: F.concat(a, p)), 256)


def cache_key(pages: Column, prompt: Column, model: Column, version: Column) -> Column:
    """SHA-256 of what a reply depends on. Each page goes with its length in eight bytes before it, so that other cuts of the same bytes differ."""
    one = lambda p: F.concat(F.unhex(F.lpad(F.hex(F.octet_length(p).cast("long")), 16, "0")), p)
    body = F.aggregate(pages, F.lit(b""), lambda a, p: F.concat(a, one(p)))
    zero = F.lit(b"\x00")
    return F.sha2(F.concat(body, zero, F.encode(prompt, "UTF-8"), zero, F.encode(model, "UTF-8"), zero, F.encode(version, "UTF-8")), 256)
