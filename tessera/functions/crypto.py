"""Envelope encryption with Spark's AES functions: blobs are IV (12 bytes), tag (16), ciphertext."""

from __future__ import annotations

import hashlib
import struct

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def encrypt(data: Column, key: Column, iv: Column | None = None, aad: Column | None = None) -> Column:
    """AES-256-GCM with a random IV, unless one is given. Spark puts the tag last; here it follows the IV."""
    sealed = F.aes_encrypt(data, key, F.lit("GCM"), F.lit("NONE"), *([iv] if iv is not None else [F.lit(b"").cast("binary")]), *([aad] if aad is not None else []))

    def ordered(x: Column) -> Column:
        n = F.octet_length(x)
        return F.concat(F.substring(x, 1, 12), x.substr(n - 15, F.lit(16)), x.substr(F.lit(13), n - 28))

    # As an element of an array it is sealed once, so all parts have the same IV.
    return F.get(F.transform(F.array(sealed), ordered), 0)


def decrypt(blob: Column, key: Column, aad: Column | None = None) -> Column:
    """The plaintext, or null if the blob was tampered with or the key is another."""
    n = F.octet_length(blob)
    sealed = F.concat(F.substring(blob, 1, 12), blob.substr(F.lit(29), n - 28), F.substring(blob, 13, 16))
    args = [F.lit("GCM"), F.lit("NONE")] + ([aad] if aad is not None else [])
    return F.try_aes_decrypt(sealed, key, *args)


def key_of(passphrase: str, tenant: str, n: int = 65536, r: int = 8, p: int = 1) -> bytes:
    """The key-encryption key of a tenant, by scrypt, once on the driver."""
    if n & (n - 1) or not 2**14 <= n <= 2**20 or not 1 <= r <= 255 or not 1 <= p <= 255:
        raise ValueError("scrypt parameters out of range")
    salt = hashlib.sha256(tenant.encode()).digest()
    return hashlib.scrypt(passphrase.encode(), salt=salt, n=n, r=r, p=p, dklen=32, maxmem=256 * n * r)


def header(n: int = 65536, r: int = 8, p: int = 1) -> bytes:
    """Version, kind of key derivation, length and parameters, in front of a wrapped key and authenticated with it."""
    parameters = struct.pack(">IBB", n, r, p)
    return struct.pack(">BBH", 1, 1, len(parameters)) + parameters


def key_table(spark: SparkSession, keys: dict[str, bytes]) -> DataFrame:
    """Data keys by tenant (columns tenant, data_key), to be joined to rows: plans and event logs don't show their values."""
    return F.broadcast(spark.createDataFrame([(t, bytearray(k)) for t, k in keys.items()], "tenant string, data_key binary"))


def wrap_key(spark: SparkSession, data_key: bytes, passphrase: str, tenant: str, n: int = 65536, r: int = 8, p: int = 1) -> bytes:
    """A data key sealed with the tenant's key-encryption key; the header in front is authenticated with it. One value, on the driver."""
    head = header(n, r, p)
    row = spark.createDataFrame([(bytearray(data_key), bytearray(key_of(passphrase, tenant, n, r, p)), bytearray(head))], "data binary, key binary, head binary")
    return head + bytes(row.select(encrypt(F.col("data"), F.col("key"), F.lit(b""), F.col("head"))).first()[0])


def parse_wrapped(blob: bytes) -> tuple[int, int, int, bytes, bytes]:
    """n, r, p, the header and the sealed key of a wrapped key; an unknown version, a bad length or missing bytes are errors."""
    if len(blob) < 4:
        raise ValueError("wrapped key is too short")
    version, kind, length = struct.unpack(">BBH", blob[:4])
    if version != 1 or kind != 1 or length != 6:
        raise ValueError("unknown kind of wrapped key")
    if len(blob) < 4 + length + 28:
        raise ValueError("wrapped key is too short")
    n, r, p = struct.unpack(">IBB", blob[4:10])
    return n, r, p, blob[:10], blob[10:]


def unwrap_key(spark: SparkSession, blob: bytes, passphrase: str, tenant: str) -> bytes | None:
    """The data key, or None for another passphrase or tenant or a changed header."""
    n, r, p, head, sealed = parse_wrapped(blob)
    row = spark.createDataFrame([(bytearray(sealed), bytearray(key_of(passphrase, tenant, n, r, p)), bytearray(head))], "data binary, key binary, head binary")
    out = row.select(decrypt(F.col("data"), F.col("key"), F.col("head"))).first()[0]
    return None if out is None else bytes(out)


def keys_match(spark: SparkSession, source: bytes, target: bytes | None, passphrase: str, tenant: str) -> bool:
    """Whether a target can take the source's objects: it has no key yet, or both unwrap to the same one."""
    if target is None:
        return True
    mine = unwrap_key(spark, source, passphrase, tenant)
    return mine is not None and mine == unwrap_key(spark, target, passphrase, tenant)
