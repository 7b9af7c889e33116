"""The same text rules for Python code that runs in workers."""

import re

from .text import CJK, WS

SPACE = re.compile(f"[{WS}]+")
_EDGES = re.compile(f"^[{WS}]+|[{WS}]+$")
_CJK = re.compile(f"[{CJK}]")
_PROSE = re.compile(rf"[.!?;:][\"')\]]?[{WS}]|[.!?]\Z")


def strip(text: str) -> str:
    return _EDGES.sub("", text)


def squeeze(text: str) -> str:
    return SPACE.sub(" ", text).strip(" ")


def units(text: str) -> int:
    """UTF-16 units."""
    return len(text) if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) // 2


def is_cjk(text: str) -> bool:
    n = 0 if text.isascii() else len(_CJK.findall(text))
    return n > 0 and n > 0.3 * units(text)


def looks_prose(text: str) -> bool:
    return is_cjk(text) or bool(_PROSE.search(strip(text)))


def estimate_tokens(text: str) -> int:
    n = len(_CJK.findall(text))
    return -(-(units(text) - n) // 4) + n
