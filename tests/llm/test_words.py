"""Language-model scores, periodic runs and fill-in-middle: brute force, edge cases, exact round trips."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from test_llm import docs, prose

from sparkquarry.llm import fim, lm, periodic

SPACE = " \t\n\x0b\f\r"


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# ---- language model

def texts():
    r = random.Random(3)
    some = [" ".join(r.choices(["the", "The", "a", "cat", "dog", "sat", "ran", "ö", f"w{i}"], k=r.randint(1, 60))) for i in range(400)]
    return [*some, None, "", " \n ", (7, "a row that shares its id"), (7, "a row that shares its id"), (None, "no id the cat"), "x " * 30_000]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_counting(spark, order, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK", 3000)
    monkeypatch.setattr(lm, "BUCKET", 5000)
    d = docs(spark, texts())
    _, _, weights, (total, types) = lm.learned(d, order)
    rows = [(r.doc_id, [w.encode().lower() for w in split(r.text)] + [None]) for r in d.collect()]
    h = lambda i: -1 if i is None else zlib.crc32(str(i).encode())
    counts, contexts = Counter(), Counter()
    for i, words in rows:
        if i is not None and h(i) % 7 != 2:
            w = ["<"] * (order - 1) + words
            for k in range(order - 1, len(w)):
                for n in range(order):
                    counts[(*w[k - n : k], w[k])] += 1
                    contexts[tuple(w[k - n : k])] += 1
    n_all, v = sum(c for g, c in counts.items() if len(g) == 1), sum(len(g) == 1 for g in counts)
    assert (total, types) == (n_all, v)
    want = []
    for i, words in rows:
        w, score, base = ["<"] * (order - 1) + words, 0.0, 0.0
        for k in range(order - 1, len(w)):
            p = 1 / (v + 1)
            for n in range(order):
                c = contexts[tuple(w[k - n : k])]
                if c:
                    x = weights[n, 1 + int(math.log2(c))]
                    p = x * counts[(*w[k - n : k], w[k])] / c + (1 - x) * p
            score, base = score + math.log10(p), base + math.log10((counts[(w[k],)] + 1) / (n_all + v + 1))
        want.append((-1 if i is None else i, i is not None and h(i) % 7 == 2, len(words), sum(counts[(x,)] > 0 for x in words), n_all, base, score))
    got = sorted((-1 if r.doc_id is None else r.doc_id, *list(r)[1:]) for r in lm.scored(d, order).collect())
    assert len(got) == len(want)
    for g, x in zip(got, sorted(want), strict=True):
        assert g[:5] == x[:5] and abs(g[5] - x[5]) < 1e-6 * (1 + abs(x[5])) and abs(g[6] - x[6]) < 1e-6 * (1 + abs(x[6]))


def test_weights_settle_where_the_texts_set_aside_are_likeliest(spark, monkeypatch):
    monkeypatch.setattr(lm, "ROUNDS", 60)
    monkeypatch.setattr(lm, "SETTLED", 1e-6)
    r = random.Random(5)
    d = docs(spark, [" ".join(f"{a} {a}{r.choice('xy')}" for a in r.choices("abcdefg", k=40)) for _ in range(300)])
    blocks, answers, weights, (_, types) = lm.learned(d)
    kept = answers[0].where("block is null").agg({"kept": "sum"}).first()[0]
    rows = lm._answered(blocks.where("deleted"), [a.where("deleted") for a in answers]).toArrow().to_batches()
    parts = [b.likelihoods(b.kept, kept) for b, _ in lm._read(rows, 2)]
    # one more use and one more reach without it, by which each weight is held off 0 and 1, are part of what is maximised
    total = lambda w: sum(np.log(lm.mixed(ml, k, w, types)[-1]).sum() for ml, k in parts) + np.log(w[w > 0]).sum() + np.log(1 - w).sum()
    best = total(weights)
    for at in np.argwhere((weights != 0.5) & (weights > 0)):
        for step in (-0.03, 0.03):
            other = weights.copy()
            other[tuple(at)] = min(max(other[tuple(at)] + step, 1e-6), 1 - 1e-6)
            assert total(other) <= best + 1e-3
    # after a letter comes one of two words: pairs tell far more than words alone
    out = lm.scored(d).toPandas()
    assert out[out.held_out].score.sum() > 0.7 * out[out.held_out].base_score.sum()


def test_nothing_to_learn_from(spark):
    assert lm.scored(docs(spark, ["a"]).limit(0)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = lm.scored(docs(spark, [(held, "a b"), (None, "c")])).collect()
    assert sorted(x.n_tokens for x in r) == [2, 3] and all((x.score, x.base_score, x.n_known, x.train_tokens) == (0, 0, 0, 0) for x in r)


# ---- periodic runs

def plain_runs(w):
    """All stretches that no word extends, for each period, and none that has a smaller one."""
    found = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            if n >= max(6, 4 * q) and not any(all(w[x] == w[x + r] for x in range(i, i + n - r)) for r in range(1, q)):
                found.append((i, n, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_by_brute_force():
    r = random.Random(1)
    for _ in range(1500):
        w = [r.randint(0, r.choice([0, 1, 1, 2, 3])) for _ in range(r.randint(0, 90))]
        for _ in range(r.randint(0, 3) if len(w) > 8 else 0):
            a, p = r.randrange(len(w)), r.randint(1, 14)
            for i in range(a, r.randint(a, len(w))):
                w[i] = w[a + (i - a) % p]
        assert periodic.runs_of(np.array(w, np.int64)) == plain_runs(w), w


def test_long_texts_cost_little():
    assert periodic.runs_of(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    assert periodic.runs_of(np.arange(300_000) % 777) == [(0, 300_000, 777)]
    x = np.r_[np.arange(1000) + 10, np.zeros(50_000, np.int64), np.arange(1000) + 2000]
    assert periodic.runs_of(x) == [(1000, 50_000, 1)]


def test_run_digests(spark):
    ten = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = [*[(i, prose(i, 30 + i % 200)) for i in ten[:30]], *[(i, prose(i, 50) + " x y" * 5) for i in range(20)], (1, None), (2, ""), (ten[0], SPACE), (None, "a " * 9), (None, "a " * 9), (5, "é" * 3 + " x \x85 " * 8)]
    got = sorted(map(str, periodic.digests(docs(spark, rows)).collect()))
    want = []
    for i, t in rows:
        w = split(t)
        h = 1 if i is None else zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            a, g = (h // 10) % len(w), h // 10
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]
        runs = plain_runs(w)
        s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        left = " ".join(x for k, x in enumerate(w) if not any(b + c <= k < b + m for b, m, c in runs))
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append(f"Row(doc_id={i}, n_runs={len(runs)}, start={s}, length={n}, period={q}, exponent_milli={1000 * n // q if runs else None}, runs_sha256='{sha(''.join(f'{b},{m},{c}' + chr(10) for b, m, c in runs))}', collapsed_sha256='{sha(left)}')")
    assert got == sorted(want)
    assert any("n_runs=1" in x for x in want) and periodic.digests(docs(spark, ["a"]).limit(0)).count() == 0


# ---- fill-in-middle

def test_cuts_by_brute_force(spark):
    rows = [*[(i, prose(i, 1 + i % 90) + SPACE * (i % 3)) for i in range(120)], *[(i, "one two   \U0001f600 x\n\n" * 3) for i in range(20)], (3, None), (4, ""), (5, "a <P> b"), (6, "<M>"), (7, SPACE), (None, "no id here"), (9, "word " * 40_000), (None, None)]
    rows += [(8, "repeated row"), (8, "repeated row")] * 3 + [(i, "repeated row") for i in range(200, 210)] * 2
    d = docs(spark, rows)
    out = fim.transformed(d)
    want = []
    for i, t in rows:
        t = t or ""
        u = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
        digest = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
        h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
        a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
        p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
        if not t or re.search("<[PSM]>", t) or h[2] % 100 >= 50:
            want.append((i, len(u), "plain", None, None, t))
        elif h[3] % 100 < 80:
            want.append((i, len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"))
        else:
            want.append((i, len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    assert {"plain", "spm", "psm"} == {w[2] for w in want}
    back = out.select(fim.restored(out.output, out.form)).collect()
    assert sorted(r[0] for r in back) == sorted(t or "" for _, t in rows)
    assert fim.digests(d.limit(0)).count() == 0



def test_cuts_share_one_exchange(spark):
    """Texts are dealt out once: windows, joins and sums over their units take the same exchange."""
    joins = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for k, v in (("spark.sql.adaptive.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
        spark.conf.set(k, v)
    try:
        plan = fim.transformed(docs(spark, [prose(1, 20)]))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", joins)
    assert len(re.findall(r"(?<!Reused)Exchange hashpartitioning", re.sub(r"ReusedExchange.*", "", plan))) == 1 and plan.count("ReusedExchange") == 2
