"""Authenticated decryption by Spark's own AES-GCM, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decrypted(ciphertext: Column, iv: Column, mac: Column, key: Column, aad: Column | None = None) -> Column:
    """The plaintext of a block under suites 6 to 8 (GCM at 128, 192 and 256 bits); iv of 12 bytes, mac of 16.

    A wrong key, mac or associated data is an error. Suites 3 to 5 (CCM) have no counterpart in Spark.
    """
    sealed = F.concat(iv, ciphertext, mac)
    return F.aes_decrypt(sealed, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b"") if aad is None else aad)


def try_decrypted(ciphertext: Column, iv: Column, mac: Column, key: Column, aad: Column | None = None) -> Column:
    """As decrypted, but null where that would be an error."""
    sealed = F.concat(iv, ciphertext, mac)
    return F.try_aes_decrypt(sealed, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b"") if aad is None else aad)
