"""Cutting texts at places where a byte-level tokenizer's pretokens always end.

A space or line break whose two neighbours are no white space starts a new pretoken whatever surrounds it (a space
joins the word after it, a lone line break stands alone), so the text may be cut before it, and after the line
break. Texts in which white space meets white space are cut only where the rule holds.
"""

from __future__ import annotations

import re

_MEETS = re.compile(r"\s\s|[^\S \n]|\A\s|\s\Z")
_SAFE = re.compile(r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)")


def cut(text: str) -> list[str]:
    """Segments that join to ``text`` and can be tokenized one by one."""
    if _MEETS.search(text):
        return [s for s in _SAFE.split(text) if s]
    out: list[str] = []
    for line in text.split("\n"):
        first, *rest = line.split(" ")
        out.append(first)
        out += [" " + w for w in rest]
        out.append("\n")
    del out[-1:]
    return out if text else []


def peel(segment: str) -> tuple[str, str]:
    """A segment without the plain punctuation after its last letter, and that punctuation: a pretoken ends between."""
    base = segment.rstrip(".,!?;:")
    return (base, segment[len(base) :]) if base[-1:].isalpha() else (segment, "")
