"""Words of a text, as all text operators here understand them."""

from __future__ import annotations

import re
import unicodedata

# Invisible characters that are removed before anything else.
INVISIBLE = dict.fromkeys([0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x00AD])
_RUN = re.compile(r"[^\W_]+")


def normalise(text: str) -> str:
    """Without invisible characters, in Unicode form NFKC, in lower case."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFKC", text.translate(INVISIBLE)).lower()


def words(text: str | None) -> list[str]:
    """Longest runs of letters and digits of the normalised text; none for null."""
    return _RUN.findall(normalise(text)) if text else []
