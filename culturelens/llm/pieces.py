r"""Cut texts where a byte-level pattern cuts them, with most of the work shared.

The pattern joins one space with the run that follows, and only white space with
white space. So a single space between two other characters always starts a match,
and a text may be cut there first; the chunks repeat across texts, and the pattern
need only run on new ones. Texts with a space beside other white space are left whole.
"""

from __future__ import annotations

import regex

BESIDE = regex.compile(r"\s |  | \s|^ | $")


class Cutter:
    def __init__(self, pattern: str) -> None:
        self.pattern = regex.compile(pattern)

    def chunks(self, text: str) -> list[str]:
        """Parts of `text` that the pattern never joins."""
        if not text:
            return []
        if BESIDE.search(text):
            return self.pattern.findall(text)
        first, *rest = text.split(" ")
        return [first, *[" " + r for r in rest]]

    def pieces(self, chunk: str) -> list[str]:
        return self.pattern.findall(chunk)
