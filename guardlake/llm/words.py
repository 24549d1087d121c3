"""The word rule that the text operators share: A-Z lower-cased, words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+."""

from __future__ import annotations

import re

#: Bytes of UTF-8 text folded to lower case, those outside words turned into spaces.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: The same words in an unfolded text.
WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def folded_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()
