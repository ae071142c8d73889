"""Keys of fingerprints, sets of keys, and Jaccard similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_CERT = "n|"


def destination_key(ip: str = "dst", port: str = "dport") -> Column:
    return F.concat(F.lit("d|"), F.col(ip), F.lit("|"), F.col(port).cast("string"))


def certificate_key(cert: str = "cert") -> Column:
    """The certificate's key; a missing certificate is a key of its own."""
    return F.coalesce(F.concat(F.lit("c|"), F.col(cert)), F.lit(NO_CERT))


def fingerprint_id(keys: Column, in_order: bool = False) -> Column:
    """Identity of a fingerprint: a digest of its sorted keys alone (in_order: they are sorted)."""
    return F.sha2(F.array_join(keys if in_order else F.array_sort(keys), "\n").cast("binary"), 256)


def union_keys(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """Shared keys over all keys; 0 for two empty sets."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def jaccard_of_counts(shared: Column, a: Column, b: Column) -> Column:
    return shared / F.greatest(a + b - shared, F.lit(1))


def sizes_can_reach(a: Column, b: Column, threshold: float) -> Column:
    """Whether sets of these sizes may be similar enough; kept in doubles as (m - n) / max(m, 1) <= 1 - threshold."""
    low, high = F.least(a, b), F.greatest(a, b)
    return (low > 0) & ((high - low) / F.greatest(high, F.lit(1)) <= F.lit(1.0) - F.lit(float(threshold)))


def destinations_of(keys: Column) -> Column:
    return F.array_sort(F.transform(F.filter(keys, lambda k: k.startswith("d|")), lambda k: F.struct(F.split_part(k, F.lit("|"), F.lit(2)).alias("ip"), F.split_part(k, F.lit("|"), F.lit(3)).cast("int").alias("port"))))


def certificates_of(keys: Column) -> Column:
    """Serial numbers in numeric order (they may exceed any decimal type)."""
    serials = F.transform(F.filter(keys, lambda k: k.startswith("c|")), lambda k: F.substring(k, 3, 2147483647))
    return F.transform(F.array_sort(F.transform(serials, lambda s: F.struct(F.length(s).alias("n"), s.alias("s")))), lambda x: x["s"])


def time_bin(x: Column, width: float) -> Column:
    """Number of the bin of a non-negative time, equal to floor division of doubles."""
    w = F.lit(float(width))
    return F.floor((x - x % w) / w + F.lit(0.5)).cast("int")


def clock(ts: Column) -> Column:
    return F.date_format(F.timestamp_micros(F.round(ts * 1e6).cast("long")), "HH:mm:ss.SSSSSS")
