"""Signatures and ciphers over columns. HMAC is built from SHA-256, with the key's pads prepared when the plan is made, so no UDF is needed."""

from __future__ import annotations

import base64
import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def hmac_sha256(message: Column, key: bytes) -> Column:
    """HMAC-SHA256 as binary."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda x: F.lit(bytearray(b ^ x for b in key))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), message.cast("binary")), 256))
    return F.unhex(F.sha2(F.concat(pad(0x5C), inner), 256))


def signature_ok(secret: str, id_: Column, timestamp: Column, body: Column, header: Column) -> Column:
    """Whether any of the header's space-separated `version,signature` entries signs `id.timestamp.body`. Without any of these nothing is signed."""
    key = base64.b64decode(secret.removeprefix("whsec_"))
    want = F.base64(hmac_sha256(F.concat(id_, F.lit("."), timestamp, F.lit("."), body), key))
    return F.coalesce(F.exists(F.split(header, " "), lambda x: F.get(F.split(x, ","), F.lit(1)) == want), F.lit(False))


def fresh(timestamp_s: Column, as_of_s: Column, tolerance_s: int = 300) -> Column:
    """Within the tolerance on either side, ends included."""
    return F.coalesce(F.abs(as_of_s - timestamp_s) <= tolerance_s, F.lit(False))


def seal(text: Column, key: Column) -> Column:
    """AES-GCM: 12 bytes of nonce, ciphertext, 16 bytes of tag; in base64."""
    return F.base64(F.aes_encrypt(text, key, F.lit("GCM")))


def unseal(blob: Column, key: Column) -> Column:
    return F.try_aes_decrypt(F.unbase64(blob), key, F.lit("GCM")).cast("string")
