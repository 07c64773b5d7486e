"""Dictionaries in one pass: an Aho-Corasick automaton finds which entries a text holds, in Arrow batches.

However long a dictionary is, a text is read once; what is done then is done for the few entries that it holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_BUILT: dict[int, ahocorasick.Automaton] = {}


def built(phrases: tuple[str, ...]) -> ahocorasick.Automaton:
    """The automaton of a dictionary, built once in a Python worker; a phrase's value is where the dictionary has it."""
    key = hash(phrases)
    if key not in _BUILT:
        a = ahocorasick.Automaton()
        places: dict[str, list[int]] = {}
        for i, p in enumerate(phrases):
            places.setdefault(p, []).append(i)
        for p, own in places.items():
            a.add_word(p, own)
        a.make_automaton()
        _BUILT[key] = a
    return _BUILT[key]


def found(text: Column, groups: tuple[tuple[str, ...], ...]) -> Column:
    """Which groups have a phrase that the lower-cased text holds anywhere: their numbers, ascending; none in a null text."""
    phrases = tuple(p.lower() for g in groups for p in g if p)
    of = tuple(i for i, g in enumerate(groups) for p in g if p)

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = built(phrases)
        for texts in batches:
            out = []
            for t in texts:
                hits = {id(own): own for _, own in automaton.iter(t)} if t and phrases else {}
                out.append(sorted({of[i] for own in hits.values() for i in own}))
            yield pd.Series(out, index=texts.index)

    return run(F.lower(text))


def _meets(before: str, after: str) -> bool:
    """Whether a word that ends in ``before`` and goes on beyond it can be the key ``after``: some beginning of the key, up to a
    place where words end, is the end of the other."""
    return any(before.endswith(after[:i]) and not re.match(r"\w", after[i]) for i in range(1, len(after)))


def reachable(table: dict[str, str]) -> tuple[tuple[str, ...], ...]:
    """For each entry the keys whose presence in a text can bring it up: its own, and those whose replacement holds it or
    makes it together with what stands beside."""
    keys, values = [k.lower() for k in table], [v.lower() for v in table.values()]
    brings = [[k in v or _meets(v, k) or _meets(v[::-1], k[::-1]) for k in keys] for v in values]
    out = []
    for i in range(len(keys)):
        have, more = {i}, {i}
        while more:
            more = {j for j in range(len(keys)) for m in more if brings[j][m]} - have
            have |= more
        out.append(tuple(keys[j] for j in sorted(have)))
    return tuple(out)
