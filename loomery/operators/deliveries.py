"""Signed deliveries: a chain of guards with one reason for each row, and redeeming one-time codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.crypto import signature_ok
from ..functions.text import sha256_base64url
from ..functions.variants import text
from .publishing import number_of

ACCEPTED = "accepted"


def guard(secret: str, id_: Column, timestamp: Column, signature: Column, body: Column, received_s: Column, tag: str, tolerance_s: int = 300) -> Column:
    """Why a delivery is not taken, or accepted; the first guard that fails decides.

    missing_headers: no (or an empty) id, timestamp or signature. stale_timestamp: no finite number, or more than the tolerance from the time of receipt.
    bad_signature: no entry of the header signs id, timestamp and body. bad_body: no JSON object. ignored: an event with another tag.
    """
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    at = number_of(timestamp)
    off = at.isNull() | F.isnan(at) | (F.abs(received_s - at) > tolerance_s)
    kind = text(F.try_parse_json(body), "type")
    return (
        F.when(blank(id_) | blank(timestamp) | blank(signature), "missing_headers")
        .when(F.coalesce(off, F.lit(True)), "stale_timestamp")
        .when(~signature_ok(secret, id_, timestamp, F.coalesce(body, F.lit("")), signature), "bad_signature")
        .when(F.coalesce(~F.schema_of_variant(F.try_parse_json(body)).startswith("OBJECT"), F.lit(True)), "bad_body")
        .when(F.coalesce(kind != tag, F.lit(True)), "ignored")
        .otherwise(ACCEPTED)
    )


def first_deliveries(deliveries: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """Of the rows of each id the first, reduced map-side. The streaming form drops repeats within its watermark."""
    rest = [c for c in deliveries.columns if c != id_col]
    return deliveries.groupBy(id_col).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("s")).select(id_col, "s.*")


# An attempt's verdicts, in the order of the checks.
INVALID, GONE, EXPIRED, CLIENT, REDIRECT, PKCE, OK = "invalid_request", "unknown_or_used", "expired", "other_client", "other_redirect", "pkce_failed", "ok"


def well_formed(code: Column, verifier: Column, client: Column) -> Column:
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    return ~(blank(code) | blank(verifier) | blank(client))


def redeem_codes(codes: DataFrame, attempts: DataFrame) -> DataFrame:
    """Adds verdict to attempts: the first well-formed attempt on an issued code consumes it, whatever its verdict; all others find nothing.

    codes: code_hash, issued_at, expires_at, client_id, redirect_uri, challenge, a row for each code. attempts: attempt_id, at, code, verifier, client_id,
    redirect_uri. Attempts are reduced to the first of each code map-side, so a code that is tried without end is no burden; equal times go by attempt_id. An
    attempt before the code's issue finds nothing and consumes nothing; a code expires after expires_at, that moment included in its life.
    """
    c = codes.select("code_hash", "issued_at", "expires_at", F.col("client_id").alias("own_client"), F.col("redirect_uri").alias("own_redirect"), "challenge")
    a = attempts.withColumn("__hash", F.sha2("code", 256)).withColumn("__formed", well_formed(F.col("code"), F.col("verifier"), F.col("client_id")))
    tried = a.filter("__formed").join(c.select(F.col("code_hash").alias("__hash"), "issued_at"), "__hash").filter("at >= issued_at")
    first = tried.groupBy("__hash").agg(F.min(F.struct("at", "attempt_id")).alias("__first")).select(F.col("__hash").alias("__h"), F.col("__first.attempt_id").alias("__id"))
    # Only first attempts meet their codes, so the join has a row for each code at most.
    won = first.join(c, F.col("__h") == F.col("code_hash")).drop("__h", "code_hash", "issued_at")
    both = a.join(won, F.col("attempt_id") == F.col("__id"), "left")
    verdict = (
        F.when(~F.col("__formed"), INVALID)
        .when(F.col("__id").isNull(), GONE)
        .when(F.col("expires_at") < F.col("at"), EXPIRED)
        .when(~F.col("own_client").eqNullSafe(F.col("client_id")), CLIENT)
        .when(~F.col("own_redirect").eqNullSafe(F.col("redirect_uri")), REDIRECT)
        .when(~F.coalesce(sha256_base64url(F.col("verifier")) == F.col("challenge"), F.lit(False)), PKCE)
        .otherwise(OK)
    )
    return both.select(*attempts.columns, verdict.alias("verdict"))
