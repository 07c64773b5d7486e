"""Windows of model tokens against a splitter that tries every piece at every place."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F
from test_library import F1, parsed

from sparkquarry import catalog
from sparkquarry.functions import subwords
from sparkquarry.operators import chunking


def spans(text, begins, goes_on):
    out = []
    for m in re.finditer(r"[^\W_]+|[^\w\s]|_", text):
        word, at, found = m[0].lower(), 0, []
        while at < len(word) and len(word) == len(m[0]) <= 100:
            n = next((n for n in range(len(word) - at, 0, -1) if word[at : at + n] in (goes_on if at else begins)), 0)
            if not n:
                break
            found.append((m.start() + at, m.start() + at + n))
            at += n
        out += found if at == len(word) and len(word) == len(m[0]) else [(m.start(), m.end())]
    return out


def windows(n, size, overlap, least):
    out, i = [], 0
    while n and (not out or out[-1][1] < n):
        out.append((i, min(i + size, n)))
        i += max(size - overlap, 1)
    if len(out) > 1 and out[-1][1] - out[-1][0] < least:
        out[-2:] = [(out[-2][0], n)]
    return out


def test_longest_matches():
    p = subwords.Pieces(subwords.vocabulary(["un", "##afford", "##able", "##a", "run", "##n", "##ning", "!", "a"]))
    cut = lambda t: [t[a:b] for a, b in p.spans(t)]
    assert cut("Unaffordable running, a!") == ["Un", "afford", "able", "run", "ning", ",", "a", "!"]
    assert cut("unx İstanbul " + "a" * 101) == ["unx", "İstanbul", "a" * 101] and cut("") == [] and cut(" \n") == []


@pytest.mark.parametrize("d", ["/root/testdata/sf0.001"])
def test_windows_of_all_documents(spark, d):
    pieces = catalog._pieces()
    begins, goes_on = {p for p in pieces if not p.startswith("##") or p == "##"}, {p[2:] for p in pieces if p.startswith("##") and len(p) > 2}
    want, inside = [], []
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        text, context = r.text or "", f"[Section: {r.lang or ''}]\n"
        s = spans(text, begins, goes_on)
        md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
        want += [(r.doc_id, i, b - a, md5(text[s[a][0] : s[b - 1][1]])) for i, (a, b) in enumerate(windows(len(s), 512, 50, 100))]
        if len(spans(context + text, begins, goes_on)) <= 384:
            inside.append((r.doc_id, 0, md5(context + text)))
        else:
            left = max(384 - len(spans(context, begins, goes_on)), 1)
            inside += [(r.doc_id, i, md5(context + text[s[a][0] : s[b - 1][1]])) for i, (a, b) in enumerate(windows(len(s), left, 64, 0))]
    assert sorted(map(tuple, catalog.QUERIES["subword_chunks"](spark, d).collect())) == sorted(want)
    assert sorted(map(tuple, catalog.QUERIES["subword_context_windows"](spark, d).collect())) == sorted(inside)


def test_odd_texts_and_chunkers(spark):
    v = subwords.vocabulary(["a", "##b", "[", "]", ":"])
    d = spark.createDataFrame([(1, None), (2, ""), (3, " "), (4, "ab " * 300), (5, "x" * 5000)], "id long, t string")
    got = {r.id: r for r in d.select("id", subwords.token_count(F.col("t"), v).alias("n"), subwords.split(F.col("t"), v, 512, 50, 100).alias("c")).collect()}
    assert [got[i].n for i in range(1, 6)] == [0, 0, 0, 600, 1] and [[c.tokens for c in got[i].c] for i in range(1, 6)] == [[], [], [], [512, 138], [1]]
    pieces = catalog._pieces()
    plain, own = (chunking.generic_chunks(parsed(spark, F1), p).select("chunk").collect() for p in (None, pieces))
    assert len(own) == len(plain) and "Patient ID: 12345" in own[0].chunk
    c = chunking.healthcare_chunks(parsed(spark, F1), pieces=pieces).collect()
    assert len(c) == 3 and all(x.chunk.startswith("[Section: ") for x in c)


def test_parts_after_a_context(spark):
    """As the expressions were that counted context, both and text, each in a pass; a text is cut once."""
    pieces, context, text = catalog._pieces(), F.col("c"), F.col("t")
    rows = [("[Section: x]\n", "word " * n) for n in (0, 1, 375, 380, 384, 1000)] + [("end", "ing " * n) for n in (1, 382, 383, 384, 900)] + [("é", "té"), ("", ""), ("a " * 500, "b " * 3), (None, "x"), ("x", None)]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, c string, t string")
    left = F.greatest(F.lit(384) - subwords.token_count(context, pieces), F.lit(1))
    whole = subwords.token_count(F.concat(context, text), pieces) <= 384
    before = F.when(whole, F.array(F.concat(context, text))).otherwise(F.transform(subwords.split(text, pieces, left, 64), lambda c: F.concat(context, c["chunk"])))
    got = d.select(chunking.split_in_section(context, text, pieces).alias("now"), before.alias("before")).collect()
    assert [r.now for r in got] == [r.before for r in got]

    class Counting(subwords.Pieces):
        calls = 0

        def spans(self, text):
            self.calls += 1
            return super().spans(text)

    own = Counting(pieces)
    assert len(subwords.parts_after(own, "[Section: x]\n", "word " * 1000, 5, 384, 64)) > 1 and own.calls == 1
