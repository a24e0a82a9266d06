"""Sealing rows with AES-GCM: the payload becomes one binary column, with a fresh random nonce per row."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Timestamps with all their six digits.
FORMATS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def seal(df: DataFrame, key: Column, clear: list[str] = [], payload: str = "payload") -> DataFrame:  # noqa: B006
    """The clear columns and the rest as nonce, ciphertext and tag in one binary column."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in clear]
    plain = F.to_json(F.struct(*rest), FORMATS | {"ignoreNullFields": "false"})
    return df.select(*[f"`{c}`" for c in clear], F.aes_encrypt(plain.cast("binary"), key, F.lit("GCM")).alias(payload))


def unseal(df: DataFrame, key: Column, schema, payload: str = "payload") -> DataFrame:
    """Sealed rows with the columns of schema again; a changed payload fails."""
    plain = F.from_json(F.aes_decrypt(payload, key, F.lit("GCM")).cast("string"), schema, FORMATS)
    return df.withColumn("__row", plain).select(*[c for c in df.columns if c != payload], "__row.*")
