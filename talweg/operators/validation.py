"""Validation of uploads, messages and signed sessions."""

from __future__ import annotations

import hashlib
import hmac
import re
import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from talweg.operators.catalog import SESSION_ID

#: Fixed formats: magic bytes by extension, in hex; extensions without magic hold text.
MAGIC = {".pdf": "255044462D", ".docx": "504B0304", ".txt": "", ".md": "", ".html": "", ".htm": ""}
TEXT_HEAD = 8192
LONGEST_MESSAGE = 2000


def upload_status(name: Column, content: Column) -> Column:
    """ok, or why an upload is refused: extension, empty, signature, binary."""
    extension = F.lower(F.regexp_extract(name, r"(\.[^./\\]*)$", 1))
    data = F.coalesce(content.cast("binary"), F.lit(b""))
    head = F.hex(F.substring(data, 1, 8))
    signed = F.lit(False)
    for ext, magic in MAGIC.items():
        if magic:
            signed = F.when(extension == ext, ~F.startswith(head, F.lit(magic))).otherwise(signed)
    zero = F.hex(F.substring(data, 1, TEXT_HEAD)).rlike("^(..)*?00")
    textual = extension.isin(*[e for e, m in MAGIC.items() if not m])
    return F.when(~extension.isin(*MAGIC), "extension").when(F.octet_length(data) == 0, "empty").when(signed, "signature").when(textual & zero, "binary").otherwise("ok")


def is_message(text: Column, longest: int = LONGEST_MESSAGE) -> Column:
    size = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", ""))
    return (size >= 1) & (size <= longest)


def signed(session_id: str, key: str) -> str:
    return f"{session_id}.{hmac.new(key.encode(), session_id.encode(), hashlib.sha256).hexdigest()}"


def verified(cookies: Column, key: str) -> Column:
    """The session id of a signed cookie, or null; compared in constant time."""

    @F.pandas_udf("string")
    def check(values: pd.Series) -> pd.Series:
        def one(cookie):
            session_id = (cookie or "").partition(".")[0]
            return session_id if hmac.compare_digest(signed(session_id, key).encode(), (cookie or "").encode()) else None

        return values.map(one)

    found = check(cookies)
    return F.when(found.rlike(SESSION_ID), found)


def new_session_id() -> str:
    return uuid.uuid4().hex


def correlation_id() -> str:
    """A short name of one request, for logs and error messages."""
    return uuid.uuid4().hex[:12]


def stored_name(name: str) -> str:
    """Where an upload is kept: a name of the server's own with the upload's extension, if that is a known one."""
    extension = re.search(r"\.[^./\\]*$", name or "")
    kind = extension[0].lower() if extension else ""
    return uuid.uuid4().hex + (kind if kind in MAGIC else "")
