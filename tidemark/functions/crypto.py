"""Hashes, encryption and compression of chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType


def digest(data: Column) -> Column:
    return F.sha2(data, 256)


def nonce(chunk_id: Column) -> Column:
    """The first 12 bytes of a hexadecimal chunk id."""
    return F.unhex(F.substring(chunk_id, 1, 24))


def encrypted(data: Column, key: Column, chunk_id: Column) -> Column:
    """AES in GCM: nonce, ciphertext and tag. The key is 16, 24 or 32 bytes."""
    return F.aes_encrypt(data, key, F.lit("GCM"), F.lit("DEFAULT"), nonce(chunk_id))


def decrypted(data: Column, key: Column) -> Column:
    """Null for data that was tampered with or has another key."""
    return F.try_aes_decrypt(data, key, F.lit("GCM"), F.lit("DEFAULT"))


#: Bytes after which what has been made of a batch goes on, so that it needn't fit in memory, or in one Arrow array, as a whole.
LEAVES_AT = 4 << 20


def _mapped(batches: Iterator[pa.Array], turn: Callable[[pa.Buffer], bytes]) -> Iterator[pa.Array]:
    """turn of each value, null for null. Values go through one at a time, and leave in arrays of LEAVES_AT bytes and one value more at most."""
    for data in batches:
        done, size = [], 0
        for value in data:
            done.append(turn(value.as_buffer()) if value.is_valid else None)
            size += len(done[-1] or b"")
            if size >= LEAVES_AT:
                yield pa.array(done, pa.binary())
                done, size = [], 0
        if done:
            yield pa.array(done, pa.binary())


@F.arrow_udf(BinaryType())
def compressed(data: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Zstandard at level 3; null stays null, empty data is allowed."""
    import zstandard

    return _mapped(data, zstandard.ZstdCompressor(level=3).compress)


@F.arrow_udf(BinaryType())
def decompressed(data: Iterator[pa.Array]) -> Iterator[pa.Array]:
    import zstandard

    return _mapped(data, zstandard.ZstdDecompressor().decompress)
