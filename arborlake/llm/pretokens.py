"""Pre-tokens of byte-level BPE: the matches of a pattern over letters, numbers and white space.

Python's ``re`` has no Unicode classes, but it is fast; the classes of the basic plane are therefore spelled
out once per worker. A text with characters beyond that plane goes through ``regex``, with the same result.
"""

from __future__ import annotations

import contextlib
import re
from functools import lru_cache

import regex

# The characters with the Unicode property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _ranges(pattern: str) -> str:
    """The basic plane's characters of a class, as the inside of a bracket expression."""
    plane = "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000)
    return "".join(f"\\u{ord(m[0][0]):04x}-\\u{ord(m[0][-1]):04x}" for m in regex.finditer(f"{pattern}+", plane))


@lru_cache(maxsize=4)
def splitter(pattern: str):
    """A function from a text to the list of its pre-tokens."""
    letters, numbers = _ranges(r"\p{L}"), _ranges(r"\p{N}")
    inside = {r"\p{L}": letters, r"\p{N}": numbers, r"\s": WHITE_SPACE, r"\S": None}

    def spell(match: re.Match) -> str:
        bracket, name = match[1], match[2]
        if bracket:
            return "[" + re.sub(r"\\p\{L\}|\\p\{N\}|\\s", lambda m: inside[m[0]], bracket[1:-1]) + "]"
        return f"[^{WHITE_SPACE}]" if name == r"\S" else f"[{inside[name]}]"

    plain = re.compile(re.sub(r"(\[[^\]]*\])|(\\p\{L\}|\\p\{N\}|\\s|\\S)", spell, pattern))
    full = regex.compile(re.sub(r"(\[[^\]]*\])|(\\s|\\S)", lambda m: m[1].replace(r"\s", WHITE_SPACE) if m[1] else f"[{'^' * (m[2] == chr(92) + 'S')}{WHITE_SPACE}]", pattern))

    def split(text: str) -> list[str]:
        if text.isascii() or max(text) < "\U00010000":
            return plain.findall(text)
        return full.findall(text)

    return split


def chunks(texts: list[str | None], characters: int = 2_000_000):
    """Cut a batch of texts into runs of bounded size: (first, last + 1). One long text is a run by itself."""
    first = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text or "") > characters:
            yield first, i
            first, size = i, 0
        size += len(text or "")
    if first < len(texts):
        yield first, len(texts)


class Recent:
    """A bounded memory in two generations: when the younger is full it becomes the older, and what was not asked
    for since is forgotten."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def look_up(self, keys: list) -> tuple[list, list[int]]:
        """The values of the keys, None for those not known, and the places of these."""
        young, old = self.young, self.old
        found = list(map(young.get, keys))
        missing, at = [], -1
        with contextlib.suppress(ValueError):
            while True:
                at = found.index(None, at + 1)
                if (value := old.get(keys[at])) is None:
                    missing.append(at)
                else:
                    found[at] = young[keys[at]] = value
        return found, missing

    def remember(self, items) -> None:
        self.young.update(items)
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}
