"""Cuts that byte-level BPE pre-tokenisers make in any case."""

from __future__ import annotations

import re

#: A blank before a character that no Unicode version takes for white space starts a new token; \s of `re` takes in more than the tokenisers' does.
BLANK = re.compile(r" (?=\S)")


def spaced_chunks(text: str) -> list[str]:
    """The text cut before each single blank that a word or sign follows. Joined they are the text; each encodes on its own."""
    if not text:
        return []
    first, *rest = BLANK.split(text)
    return ([first] if first else []) + [" " + x for x in rest]


#: A blank that no word or sign follows, at which a text must not be cut.
OPEN = re.compile(r" (?!\S)")


def head_and_chunks(text: str) -> tuple[str, list[str]]:
    """The same cuts: what stands before the first of them, and the chunks after it less their blanks."""
    head, *rest = text.split(" ") if not OPEN.search(text) else BLANK.split(text)
    return head, rest
