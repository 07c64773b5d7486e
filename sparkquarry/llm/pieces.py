"""Texts as pieces whose tokens do not depend on their neighbours, so that each distinct piece is encoded once.

In the byte-level pattern no match runs from a visible character into white space.  A text may therefore be cut before
each run of white space that follows a visible character; the tokens of the cuts, one after another, are the tokens of
the text.  Most words recur, so a table per Python worker, bounded in bytes, holds the ids of those met first.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from sys import getsizeof

_SPACE = "\t-\r \x85\xa0  -     　"
_CUTS = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
_ODD = re.compile("[\t\x0b-\r\x85\xa0  -     　]")

#: Bytes of pieces and ids that a worker keeps; characters of text that are taken in at once; longest piece that is kept.
KEPT, AT_ONCE, LONGEST = 64 << 20, 1 << 20, 64
#: Bytes of a table's slot, and of the smallest entry at least.
_SLOT, _LEAST = 60, 100


def keys_of(text: str) -> list[str]:
    """The text's pieces. A key without a leading space stands for a space and itself, one with for what follows it."""
    if "  " in text or "\n " in text or text[:1] == " " or text[-1:] == " " or _ODD.search(text):
        return [p[1:] if p[0] == " " and " " not in p[1:] and len(p) > 1 else " " + p for p in _CUTS.findall(text)]
    if not text:
        return []
    keys = text.split(" ")
    keys[0] = " " + keys[0]
    return keys


def piece_of(key: str) -> str:
    return key[1:] if key[0] == " " else " " + key


class PieceTable:
    """The ids of all pieces of texts; pieces met first are kept as long as they and their ids fit into ``kept`` bytes."""

    def __init__(self, kept: int = KEPT):
        self.room, self.table = kept, {}

    def texts(self, texts: Iterable[str], encode: Callable[[list[str]], Iterable[bytes]]) -> Iterator[bytes]:
        """For each text its ids, as 32-bit integers; ``encode`` makes those of a list of pieces."""
        waiting, size = [], 0
        for text in texts:
            waiting.append(keys_of(text))
            size += len(text)
            if size >= AT_ONCE:
                yield from self._values(waiting, encode)
                waiting, size = [], 0
        yield from self._values(waiting, encode)

    def _values(self, texts: list[list[str]], encode: Callable[[list[str]], Iterable[bytes]]) -> Iterator[bytes]:
        # in one list, so that what is missing is looked for once
        keys = [k for ks in texts for k in ks]
        values = list(map(self.table.get, keys))
        missing = [i for i, v in enumerate(values) if v is None]
        new = list(dict.fromkeys([keys[i] for i in missing]))
        made = dict(zip(new, encode([piece_of(k) for k in new]), strict=True))
        for i in missing:
            values[i] = made[keys[i]]
        self._keep(made)
        at = 0
        for ks in texts:
            yield b"".join(values[at : at + len(ks)])
            at += len(ks)

    def _keep(self, made: dict[str, bytes]) -> None:
        if self.room < _LEAST or not made:
            return
        short = {k: v for k, v in made.items() if len(k) <= LONGEST}
        cost = sum(map(getsizeof, short)) + sum(map(getsizeof, short.values())) + _SLOT * len(short)
        if cost <= self.room:
            self.room -= cost
            self.table.update(short)
            return
        for k, v in short.items():
            cost = getsizeof(k) + getsizeof(v) + _SLOT
            if cost <= self.room:
                self.room -= cost
                self.table[k] = v
