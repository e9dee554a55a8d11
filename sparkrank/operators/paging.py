"""Signed cursors, unique ids, and measured depths of approximate search."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import struct
from collections.abc import Mapping, Sequence

from sparkrank.errors import Refused, require


def encode_cursor(secret: bytes, request: str, score: float, doc_id: int, keys: Sequence = ()) -> str:
    """Where a page ends: the score's 32 bits, the id and sort keys, signed for one request."""
    body = json.dumps([hashlib.sha256(request.encode()).hexdigest(), struct.pack(">f", score + 0.0).hex(), doc_id, list(keys)]).encode()
    return base64.urlsafe_b64encode(hmac.new(secret, body, hashlib.sha256).digest() + body).decode()


def decode_cursor(secret: bytes, request: str, cursor: str) -> tuple[float, int, list]:
    """Score, id and keys; refused if the cursor was changed or made for another request."""
    try:
        raw = base64.urlsafe_b64decode(cursor.encode())
        body = json.loads(raw[32:])
    except (ValueError, TypeError):
        raise Refused("no cursor") from None
    require(hmac.compare_digest(raw[:32], hmac.new(secret, raw[32:], hashlib.sha256).digest()), "a cursor with another signature")
    require(body[0] == hashlib.sha256(request.encode()).hexdigest(), "a cursor of another request")
    return struct.unpack(">f", bytes.fromhex(body[1]))[0], body[2], body[3]


def unique_ids(ids: Sequence[str]) -> None:
    """Names of parts of a request have to differ."""
    seen = set()
    for i in ids:
        require(bool(i) and i not in seen, f"the id {i!r} twice or empty")
        seen.add(i)


def measured_depth(profile: Mapping[tuple[int, float], int], k: int, recall: float) -> int:
    """The least measured depth that serves k rows at a recall; what was not measured is refused, not guessed."""
    depths = [d for (at, r), d in profile.items() if at >= k and r >= recall]
    require(bool(depths), f"no measured depth for {k} rows at {recall}")
    return min(depths)
