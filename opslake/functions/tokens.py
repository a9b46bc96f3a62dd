"""Column encryption and token claims."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLAIMS = "sub string, exp long, iat long, iss string, aud string, jti string, scopes string"


def aes_gcm_encrypt(plain: Column, key: Column, nonce: Column | None = None, aad: Column | None = None) -> Column:
    """AES-GCM; the result is nonce (12 bytes), ciphertext, tag (16 bytes).

    Without ``nonce`` a random one is drawn per row. The key has 16, 24 or 32 bytes.
    """
    if nonce is None and aad is None:
        return F.aes_encrypt(plain, key, F.lit("GCM"), F.lit("DEFAULT"))
    nonce = F.lit("").cast("binary") if nonce is None else nonce
    return F.aes_encrypt(plain, key, F.lit("GCM"), F.lit("DEFAULT"), nonce,
                         *([] if aad is None else [aad]))


def aes_gcm_decrypt(sealed: Column, key: Column, aad: Column | None = None) -> Column:
    """Plain text, or null when the key, the additional data or the ciphertext is wrong."""
    extra = [] if aad is None else [aad]
    return F.try_aes_decrypt(sealed, key, F.lit("GCM"), F.lit("DEFAULT"), *extra).cast("string")


def aes_gcm_parts(sealed: Column) -> Column:
    """Nonce, ciphertext and tag of a sealed value."""
    size = F.length(sealed)
    return F.struct(F.substring(sealed, F.lit(1), F.lit(12)).alias("nonce"),
                    F.substring(sealed, F.lit(13), size - 28).alias("ciphertext"),
                    F.substring(sealed, size - 15, F.lit(16)).alias("tag"))


def reencrypt(sealed: Column, old_key: Column, new_key: Column, nonce: Column | None = None,
              aad: Column | None = None) -> Column:
    """Open with the old key and seal with the new one; null stays null when the old key does not fit."""
    return aes_gcm_encrypt(aes_gcm_decrypt(sealed, old_key, aad), new_key, nonce, aad)


def _url_base64(part: Column) -> Column:
    return F.try_to_binary(F.translate(part, "-_", "+/"), F.lit("base64")).cast("string")


def _padded(part: Column) -> Column:
    return F.concat(part, F.repeat(F.lit("="), F.pmod(F.lit(4) - F.length(part) % 4, F.lit(4)).cast("int")))


def jwt_claims(token: Column) -> Column:
    """Struct of header algorithm and payload claims; null when the token cannot be read.

    The signature is not checked here.
    """
    parts = F.split(token, r"\.")
    header = F.from_json(_url_base64(_padded(F.get(parts, F.lit(0)))), "alg string, typ string")
    claims = F.from_json(_url_base64(_padded(F.get(parts, F.lit(1)))), CLAIMS)
    fields = ["sub", "exp", "iat", "iss", "aud", "jti", "scopes"]
    return F.when(F.size(parts) == 3, F.struct(
        header["alg"].alias("alg"), *[claims[f].alias(f) for f in fields]))


def token_valid(claims: Column, audience: str, issuer: str, as_of_epoch: int) -> Column:
    """Required claims present, audience and issuer equal, not expired."""
    return F.coalesce(
        claims["sub"].isNotNull() & claims["exp"].isNotNull() & claims["iat"].isNotNull()
        & (claims["aud"] == audience) & (claims["iss"] == issuer) & (claims["exp"] > as_of_epoch), F.lit(False))


def scopes_granted(granted: Column, required: Column) -> Column:
    """Every required scope is among the granted ones; both are space separated."""

    def words(c):
        return F.filter(F.split(F.coalesce(c, F.lit("")), " +"), lambda s: s != "")

    return F.size(F.array_except(words(required), words(granted))) == 0
