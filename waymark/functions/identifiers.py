"""Identifier hashes. Keyed hashes run in Arrow batches over distinct identifiers only;
the key stays in the function's closure, so no plan or event log prints it."""

import hashlib
import hmac

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTIFIER_HEX = 32
KEY_BYTES = 32


def canonical_address(address) -> Column:
    """An address in its one form: trimmed and in lower case."""
    return F.lower(F.trim(address))


def legacy_identifier(address) -> Column:
    """The first 16 hex digits of the SHA-256 of the trimmed, lower-case address."""
    return F.substring(F.sha2(canonical_address(address).cast("binary"), 256), 1, 16)


def _check_key(key: bytes) -> None:
    if not isinstance(key, bytes) or len(key) != KEY_BYTES:
        raise ValueError(f"the key must be exactly {KEY_BYTES} bytes")


def keyed_hash(prefix: bytes, key: bytes):
    """Pandas UDF: HMAC-SHA-256 of prefix + text, as 32 hex digits; NULL and '' are kept."""
    import pandas as pd  # here, so that workers which only read this module do not load it

    _check_key(key)

    @F.pandas_udf("string")
    def hashed(values: pd.Series) -> pd.Series:
        return values.map(
            lambda v: hmac.new(key, prefix + v.encode(), hashlib.sha256).hexdigest()[:IDENTIFIER_HEX]
            if v else v
        )

    return hashed


def capture_prefix(domain: bytes, deployment: str) -> bytes:
    """Domain, deployment length (2 bytes, big-endian), deployment, NUL."""
    name = deployment.encode("ascii")
    return domain + len(name).to_bytes(2, "big") + name + b"\0"


def release_prefix(domain: bytes, dataset: str) -> bytes:
    """Domain, NUL, dataset, NUL."""
    return domain + b"\0" + dataset.encode("ascii") + b"\0"


def scope_prefix(domain: bytes, scope: str) -> bytes:
    """Domain, scope, NUL."""
    return domain + scope.encode("ascii") + b"\0"
