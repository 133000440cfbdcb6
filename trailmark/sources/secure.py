"""Column encryption: AES-GCM with a random nonce in front of ciphertext and tag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _key(key_base64: str) -> Column:
    return F.unbase64(F.lit(key_base64))


def encrypt_columns(df: DataFrame, columns: list[str], key_base64: str) -> DataFrame:
    """The named columns as ciphertext."""
    key = _key(key_base64)
    return df.withColumns(
        {c: F.aes_encrypt(F.col(c).cast("string").cast("binary"), key, F.lit("GCM")) for c in columns}
    )


def decrypt_columns(df: DataFrame, columns: list[str], key_base64: str) -> DataFrame:
    """The named columns as text; NULL where the key does not fit."""
    key = _key(key_base64)
    return df.withColumns({c: F.try_aes_decrypt(F.col(c), key, F.lit("GCM")).cast("string") for c in columns})


def decryption_failures(encrypted: DataFrame, columns: list[str], key_base64: str) -> DataFrame:
    """Number of cells per column that the key does not open, in one row."""
    key = _key(key_base64)
    opened = {c: F.try_aes_decrypt(F.col(c), key, F.lit("GCM")) for c in columns}
    return encrypted.agg(
        *[F.count_if(F.col(c).isNotNull() & plain.isNull()).alias(c) for c, plain in opened.items()]
    )
