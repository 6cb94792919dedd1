"""What the account tables need of a column: addresses, invite hashes, tokens and time stamps."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the account rules.
LONGEST_EMAIL, EMAIL = 254, r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
EARLIEST_S, LATEST_S = -60, 30 * 24 * 3600


#: Account tables, as Spark reads and writes them.
USERS = "id long not null, email string not null, password_hash string not null, created_at timestamp not null, last_login_at timestamp"
INVITES = "id long not null, code_hash string not null, note string, created_at timestamp not null, expires_at timestamp, used_at timestamp, used_by long"


def select(spark, text: str, *values, **tables):
    """Rows of a SQL text with ``?`` for each of ``values``, which are never part of the text; ``tables`` are its views."""
    for name, table in tables.items():
        table.createOrReplaceTempView(name)
    return spark.sql(text, args=list(values))


def email(c: Column) -> Column:
    """Trimmed and lower-cased; null unless it looks like an address of a lawful length."""
    value = F.lower(F.trim(c))
    return F.when((F.length(value) <= LONGEST_EMAIL) & value.rlike(EMAIL), value)


def invite_hash(c: Column) -> Column:
    return F.sha2(F.trim(c), 256)


def url_base64(c: Column) -> Column:
    """Base 64 for URLs, without padding."""
    return F.translate(F.regexp_replace(F.base64(c), r"\s", ""), "+/=", "-_")


def from_url_base64(c: Column) -> Column:
    plain = F.translate(c, "-_", "+/")
    return F.unbase64(F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("=")))


def token_is_current(issued_s: Column, now_s: Column) -> Column:
    """Not from the future but for a minute of clock skew, and no older than thirty days."""
    return (now_s - issued_s).between(EARLIEST_S, LATEST_S)


def _mac(message: Column, secret: str) -> Column:
    """HMAC-SHA256 in hex: the padded key goes before the message, and again before that hash."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(k ^ pad for k in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def session_token(user_id: Column, issued_s: Column, secret: str) -> Column:
    """``user.issued.signature``."""
    message = F.concat_ws(".", user_id.cast("string"), issued_s.cast("string"))
    return F.concat_ws(".", message, _mac(message, secret))


def session_user(token: Column, now_s: Column, secret: str) -> Column:
    """Whom a token was signed for; null if it is forged, malformed or not current."""
    parts = F.split(token, r"\.")
    user, issued = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    lawful = (F.size(parts) == 3) & user.rlike("^[0-9]{1,18}$") & issued.rlike("^[0-9]{1,18}$")
    signed = F.get(parts, F.lit(2)) == _mac(F.concat_ws(".", user, issued), secret)
    return F.when(lawful & signed & token_is_current(issued.try_cast("long"), now_s), user.try_cast("long"))


def to_iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def from_iso(c: Column) -> Column:
    """A time stamp from ISO 8601 text; text that isn't one is null."""
    return F.try_to_timestamp(c)
