"""Dictionaries in one pass against trying their entries one after another."""

import random
import re
import time

from pyspark.sql import functions as F

from sparkquarry.functions import automaton, vocab
from sparkquarry.functions import text as tx


def one_by_one(text, table):
    used = {}
    for k, v in table.items():
        p = rf"(?i)\b{re.escape(k)}\b"
        if re.search(p, text, re.ASCII):
            used[k] = v
            text = re.sub(p, v, text, flags=re.ASCII)
    return text, used


def test_rewriting_equals_entry_by_entry(spark):
    # entries that bring up others: inside their replacement, and with a word beside it
    chained = {"a b": "long c", "c d": "e f g", "f": "x y", "y g": "z", "q": "a", "a": "q", "n/v": "nausea", "nausea": "n/v", "long": "a b"}
    r = random.Random(4)
    for table in (chained, tx.longest_first(vocab.ABBREVIATIONS), vocab.MISSPELLINGS):
        words = [w for k, v in table.items() for w in [k, *k.split(), *v.split(), k.upper(), f"x{k}", f"{k},"]]
        rows = [(i, " ".join(r.choices(words, k=r.randint(0, 12)))) for i in range(400)]
        text, used = tx.rewritten(F.col("t"), table)
        for x in spark.createDataFrame(rows, "id long, t string").select("t", text.alias("text"), used.alias("used")).collect():
            assert (x.text, x.used) == one_by_one(x.t, table), x.t
    null = spark.createDataFrame([(None,)], "t string").select(*tx.rewritten(F.col("t"), chained)).first()
    assert null[0] is None and null[1] == {}


def test_labels_equal_phrase_by_phrase(spark):
    r = random.Random(5)
    table = vocab.ANSWER_TYPES
    words = [w for ps in table.values() for p in ps for w in (p, p[1:], p.upper())] + ["none", "of", "these"] * 40
    rows = [(" ".join(r.choices(words, k=r.randint(0, 8))),) for _ in range(400)] + [(None,), ("",)]
    for x in spark.createDataFrame(rows, "t string").select("t", tx.labels(F.col("t"), table).alias("l")).collect():
        assert x.l == ([k for k, ps in table.items() if any(p in (x.t or "").lower() for p in ps)] or ["general"])


def test_time_does_not_grow_with_the_dictionary():
    r = random.Random(6)
    make = lambda n: tuple("".join(r.choices("bcdfghjk", k=9)) for _ in range(n))
    text, took = " ".join(make(40_000)), []
    for n in (50, 50_000):
        a = automaton.built(make(n))
        began = time.process_time()
        for _ in range(3):
            sum(1 for _ in a.iter(text))
        took.append(time.process_time() - began)
    assert took[1] < 20 * took[0]  # a thousand times the entries
