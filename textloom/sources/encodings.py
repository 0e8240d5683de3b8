"""Which encoding some bytes are in that don't say it: what each candidate makes of them, scored by the kinds of neighbouring characters.

A candidate that can't decode the bytes is out. Of the text it gives, every character outside ASCII counts by how usual it is in
running text of its script (the first levels of the national character sets hold the usual ones), and by its neighbours: small letters follow
small letters of the same script, capitals and accented letters stand alone, controls and unassigned characters never occur. A character counts for the bytes
it took, so that candidates with one and with two bytes a character compare.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

#: Names of encodings, in the order in which equal scores are decided.
CANDIDATES = ("cp1252", "cp1251", "koi8-r", "cp1250", "cp932", "euc-jp", "gb18030", "big5", "euc-kr", "utf-16-le", "utf-16-be")
#: So many bytes are looked at.
SAMPLE_BYTES = 1 << 16
#: First bytes of the usual characters in each national set.
_USUAL = {"cp932": ("euc-jp", 0xB0, 0xCF), "euc-jp": ("euc-jp", 0xB0, 0xCF), "gb18030": ("gb2312", 0xB0, 0xD7), "big5": ("big5", 0xA4, 0xC6), "euc-kr": ("euc-kr", 0xCA, 0xFD)}


@lru_cache(maxsize=65536)
def _usual(char: str, encoding: str) -> bool:
    kind, low, high = _USUAL.get(encoding, ("gb2312", 0xB0, 0xD7))
    try:
        data = char.encode(kind)
    except UnicodeEncodeError:
        return False
    return len(data) == 2 and low <= data[0] <= high


@lru_cache(maxsize=65536)
def _kind(char: str) -> str:
    """Script and case: ``l`` small and ``L`` capital Latin, ``a`` and ``A`` accented, ``c`` and ``C`` Cyrillic, ``k`` kana, ``h`` Hangul, ``i`` ideographs, ``w`` half-width kana, ``x`` never in text, ``s`` other."""
    code = ord(char)
    if code < 128:
        return ("l" if char.islower() else "L") if char.isalpha() else "s" if char.isprintable() or char in "\t\r\n" else "x"
    if code < 0xA0 or unicodedata.category(char) in ("Cc", "Cn", "Co", "Cs"):
        return "x"
    if code < 0x250 and char.isalpha():
        return "a" if char.islower() else "A"
    if 0x400 <= code < 0x460:
        return "c" if char.islower() else "C"
    if 0x3041 <= code < 0x3100:
        return "k"
    if 0xAC00 <= code < 0xD7A4:
        return "h"
    if 0x4E00 <= code < 0xA000:
        return "i"
    if 0xFF61 <= code < 0xFFA0:
        return "w"
    return "s"


def _value(char: str, before: str, after: str, encoding: str) -> float:
    kind, left, right = _kind(char), _kind(before), _kind(after)
    if kind == "x":
        return -6.0
    if kind == "a":
        return (0.6 if left in "lL" or right == "l" else -0.6) - 0.8 * (left in "aA") - 0.8 * (right in "aA") - 0.4 * (left == "L" and right == "L")
    if kind == "A":
        return 0.3 if left not in "laA" and right in "ls" else -1.0
    if kind == "c":
        return -1.0 if left in "lLaA" or right in "lLaA" else 1.0 if left in "cC" or right == "c" else 0.4
    if kind == "C":
        return 0.4 if left not in "claA" and right not in "lLaA" else -1.2
    if kind == "k":
        return 1.2
    if kind == "h":
        return 1.2 if left in "hs" or right in "hs" else 0.5
    if kind == "i":
        return 0.9 if _usual(char, encoding) else -0.6
    if kind == "w":
        return -0.8
    if left in "lLaA" and right in "lLaA" and char not in "’·":
        return -2.0
    return 0.1 if 0x2010 <= ord(char) < 0x2027 or 0x3000 <= ord(char) < 0x3020 or 0xFF00 <= ord(char) < 0xFF61 or char in "«»§°·¡¿" else -0.5


def score(data: bytes, encoding: str) -> float | None:
    """How like running text the bytes are in an encoding, a byte; None if they can't be in it."""
    wide = encoding.startswith("utf-16")
    if wide and len(data) % 2:
        return None
    try:
        text = data.decode(encoding)
    except UnicodeDecodeError as e:
        if len(data) < SAMPLE_BYTES or e.start < len(data) - 4:  # a sample can end inside a character
            return None
        text = data[: e.start].decode(encoding)
    total = weight = 0.0
    for k, char in enumerate(text):
        if ord(char) < 128:
            if wide:  # two bytes for one letter
                total, weight = total + (0.9 if _kind(char) in "lL" or char == " " else 0.0 if _kind(char) == "s" else -6.0) * 2, weight + 2
            elif _kind(char) == "x":
                total, weight = total - 6, weight + 1
            continue
        size = 2 if wide or encoding in _USUAL else 1
        total += size * _value(char, text[k - 1] if k else " ", text[k + 1] if k + 1 < len(text) else " ", encoding)
        weight += size
    return total / weight if weight else 0.0


def detect(data: bytes) -> str:
    """The likeliest encoding; UTF-8 for bytes that are sound in it."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe\0\0", "utf-32"), (b"\0\0\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return name
    sample = data[:SAMPLE_BYTES]
    try:
        sample.decode("utf-8")
        if b"\0" not in sample:
            return "utf-8"
    except UnicodeDecodeError as e:
        if len(data) > SAMPLE_BYTES and e.start >= len(sample) - 4 and b"\0" not in sample:
            return "utf-8"
    best, name = None, "utf-8"
    for encoding in CANDIDATES:
        found = score(sample, encoding)
        if found is not None and (best is None or found > best + 1e-9):
            best, name = found, encoding
    return name
