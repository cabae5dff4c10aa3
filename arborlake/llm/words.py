"""Words of a text as UTF-8 bytes, window by window."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Bytes of a text whose words are lists at one time.
WINDOW = 1 << 20


def windows(data: bytes, outside: re.Pattern, size: int = WINDOW) -> Iterator[bytes]:
    """``data`` in pieces of about ``size`` bytes; a piece ends where ``outside`` matches, so no word is cut."""
    at = 0
    while at < len(data):
        found = outside.search(data, at + size)
        end = found.start() if found else len(data)
        yield data[at:end]
        at = end
