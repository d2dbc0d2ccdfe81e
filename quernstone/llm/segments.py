"""Safe places to cut a text before it is tokenized."""

from __future__ import annotations

import re
from collections.abc import Iterator

# Unicode's White_Space characters, which \s means in the tokenizers' patterns.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

WITH_SPACE = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
WITHOUT_SPACE = re.compile(f"[^{WHITE}]+")
_EDGE = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])")
# Between a sign and a letter or digit, or a letter and a digit: units end there in all patterns of such tokenizers, and no
# character before the place is composed with what follows. ASCII, CJK ideographs and kana only.
_LETTER, _SIGN = "A-Za-z\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff", ".,;:!?)\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f"
_SEAM = re.compile(f"(?<=[{_SIGN}])(?=[{_LETTER}0-9])|(?<=[{_LETTER}])(?=[0-9])|(?<=[0-9])(?=[{_LETTER}])")

#: Code points after which a long text is cut at the next safe place.
CHUNK = 1 << 20


def chunks(text: str, limit: int = CHUNK) -> Iterator[str]:
    """text in parts of about limit code points, cut only before white space that follows another character, or where there is none for limit code points more, at a seam of letters, digits and signs. A text without such a place stays whole."""
    start = 0
    while len(text) - start > limit:
        edge = _EDGE.search(text, start + limit, start + 2 * limit + 1) or _SEAM.search(text, start + limit) or _EDGE.search(text, start + limit)
        if edge is None:
            break
        yield text[start : edge.start()]
        start = edge.start()
    if start < len(text):
        yield text[start:] if start else text
