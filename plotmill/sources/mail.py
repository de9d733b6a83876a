"""Mail attachments inside JSON or MIME wrappers."""

from __future__ import annotations

import base64
import binascii
import json
from collections.abc import Iterator
from email import message_from_bytes

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _raw(body: object) -> bytes | None:
    """The message in a JSON tree: the first ``raw`` value, else the longest string that looks like one."""
    if isinstance(body, dict):
        if isinstance(body.get("raw"), str):
            return _decoded(body["raw"])
        return next((r for v in body.values() if (r := _raw(v)) is not None), None)
    if isinstance(body, list):
        return next((r for v in body if (r := _raw(v)) is not None), None)
    return None


def _decoded(text: str) -> bytes | None:
    """Base64, in the plain or the URL alphabet, with or without padding and line ends."""
    t = "".join(text.split()).replace("-", "+").replace("_", "/").rstrip("=")
    try:
        return base64.b64decode(t + "=" * (-len(t) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def attachments(mails: DataFrame, row_id: str, body: str = "body") -> DataFrame:
    """``row_id, name, content`` of the attachments. Bodies are JSON with a base64 ``raw`` message, bare base64, or the
    message itself; null, empty and unreadable bodies have none. Contents are exact bytes."""

    def parts(text: str | None) -> list[tuple[str, bytes]]:
        if not text or not text.strip():
            return []
        try:
            raw = _raw(json.loads(text))
        except ValueError:
            raw = None
        if raw is None:
            raw = _decoded(text) if ":" not in text.split("\n", 1)[0] else text.encode("utf-8", "surrogateescape")
        if raw is None:
            return []
        message = message_from_bytes(raw.replace(b"\r\n", b"\n"))
        return [(p.get_filename(), p.get_payload(decode=True) or b"") for p in message.walk() if p.get_filename()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(i, n, c) for i, t in zip(pdf["id"], pdf["body"], strict=True) for n, c in parts(t)]
            yield pd.DataFrame(out, columns=["row_id", "name", "content"]).astype({"row_id": "int64"})

    return mails.where(F.col(row_id).isNotNull()).select(F.col(row_id).cast("bigint").alias("id"), F.col(body).cast("string").alias("body")).mapInPandas(run, "row_id bigint, name string, content binary")
