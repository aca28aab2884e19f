"""Build one regex per rule from plain phrase lists."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column

from lexmine.functions.text import WORD


@dataclass(frozen=True)
class Rule:
    """A label and the phrases that earn it. Phrases are regex fragments over lower-case text.

    ``words`` match between word edges, ``dotted`` end in a dot that a word character must follow,
    ``starts`` and ``ends`` are anchored, ``contains`` match anywhere.
    """

    label: str
    words: Sequence[str] = ()
    dotted: Sequence[str] = ()
    starts: Sequence[str] = ()
    contains: Sequence[str] = ()
    ends: Sequence[str] = ()

    def regex(self) -> str:
        parts = []
        if self.starts:
            parts.append(f"^(?:{'|'.join(self.starts)})")
        if self.words:
            parts.append(f"(?<!{WORD})(?:{'|'.join(self.words)})(?!{WORD})")
        if self.dotted:
            parts.append(rf"(?<!{WORD})(?:{'|'.join(self.dotted)})\.(?={WORD})")
        parts.extend(self.contains)
        parts.extend(f"{end}$" for end in self.ends)
        return "|".join(parts)

    def hit(self, text: Column) -> Column:
        return text.rlike(self.regex())
