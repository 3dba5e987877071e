"""Encryption of values: AES-256-GCM in an envelope ENC[version|iv|tag|text] of base64 parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvtrail.functions import kv

VERSION = "1"


def encrypt_value(value: Column, key: Column) -> Column:
    """An envelope of the value; key has 32 bytes. A null value stays null."""

    def envelope(sealed: Column) -> Column:  # nonce of 12 bytes, text, tag of 16
        n = F.octet_length(sealed)
        part = lambda a, b: F.base64(F.substring(sealed, a, b))
        return F.concat(F.lit(f"ENC[{VERSION}|"), part(1, 12), F.lit("|"), part(n - 15, F.lit(16)), F.lit("|"), part(F.lit(13), n - 28), F.lit("]"))

    # every evaluation draws a nonce of its own, so the parts have to come from one array item
    return F.transform(F.array(F.aes_encrypt(value, key, F.lit("GCM"))), envelope)[0]


def decrypt_value(envelope: Column, key: Column) -> Column:
    """The value, or null where the envelope or the key is wrong."""
    parts = F.split(F.regexp_extract(envelope, r"^ENC\[(.*)\]\z", 1), r"\|")
    piece = lambda k: F.try_to_binary(F.try_element_at(parts, F.lit(k)), F.lit("base64"))
    return F.try_aes_decrypt(F.concat(piece(2), piece(4), piece(3)), key, F.lit("GCM")).cast("string")


def rotate(envelope: Column, old: Column, new: Column) -> Column:
    """Sealed anew under another key; what does not open stays as it is. The old text is opened once."""
    return F.coalesce(encrypt_value(decrypt_value(envelope, old), new), envelope)


def encrypted_pairs(df: DataFrame, keys: list[str], key: Column | None = None) -> DataFrame:
    """Dialect of sealed files: the opened value, whether it was sealed, and the raw value of each variable; last wins.

    A value that the key does not open stays as it is and does not count as sealed;
    without a key all sealed values stay and count.
    """
    opener = "_opener"
    rows = df if key is None else df.withColumn(opener, key)
    pairs = kv.export_pairs(rows, keys if key is None else [*keys, opener])
    sealed = kv.is_encrypted(F.col("value"))
    opened = F.when(sealed, decrypt_value(F.col("value"), F.col(opener))) if key is not None else F.when(sealed, F.col("value"))
    pairs = pairs.select(*keys, "key", F.col("value").alias("raw"), opened.alias("opened"))
    return pairs.select(*keys, "key", F.coalesce("opened", "raw").alias("value"), F.col("opened").isNotNull().alias("encrypted"), "raw")
