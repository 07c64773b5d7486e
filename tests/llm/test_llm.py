"""Edge cases and brute-force comparisons of the training-data operators."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkquarry.llm import bpe, chat, linededup, minhash, mixing, nndescent, pieces, tokenfile, topk, toxicity, warc
from sparkquarry.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, sources=None):
    """Documents with an extra column whose name clashes with inner ones."""
    rows = [(i if t is None or not isinstance(t, tuple) else t[0], t if not isinstance(t, tuple) else t[1]) for i, t in enumerate(texts)]
    rows = [(i, t, "en", (sources or ["s"])[n % len(sources or ["s"])], len(t or "")) for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(rows, DOCS).withColumn("rank", F.lit("x")).withColumn("key", F.lit(1)).withColumn("size", F.lit(None).cast("string"))


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(n))


# ---- mixing

def test_mix_reaches_targets_and_keeps_the_limit(spark):
    texts = [prose(i, 40 + i % 300) for i in range(200)] + [None, "", " \n"]
    d = docs(spark, texts, ["a", "b", "c", None])
    out = mixing.taken(d).toPandas()
    assert len(out) == 203 and (out.taken <= 3 * out["size"]).all()
    src = out.assign(s=out.source_size).groupby("s").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert (src.index == src["size"]).all()
    assert abs(src.target.sum() - out["size"].sum()) < 1e-6
    assert ((src.taken - src.target).abs() <= 3 * mixing.BLOCK).all()
    again = mixing.taken(d.repartition(7)).toPandas()
    assert (out.sort_values("doc_id").taken.to_numpy() == again.sort_values("doc_id").taken.to_numpy()).all()


def test_targets_share_the_excess_by_weight(spark):
    t = mixing.targets(spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 400), ("e", 0)], "source string, source_size long")).toPandas().set_index("rank").sort_index()
    # a (5) stops at 30, e has nothing; b (2), c (1) and null (2: the fifth source) share 1880 as 2:1:2, none above its limit
    assert t.source.iloc[-1] is None and t.target.iloc[0] == 30 and t.target.iloc[3] == 0
    assert np.allclose(t.target.iloc[[1, 2, 4]], [1880 * 2 / 5, 1880 / 5, 1880 * 2 / 5])


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 100, 1000):
        out = spark.range(n).select(mixing.permuted("id", f"{n}L", "12345L").alias("x")).toPandas().x
        assert sorted(out) == list(range(n))


def test_mixed_documents_hold_what_was_taken(spark):
    d = docs(spark, [prose(i, 150) for i in range(40)], ["a", "b", "c"])
    t = mixing.taken(d).toPandas().set_index("doc_id").taken
    m = mixing.mixed_documents(d)
    assert m.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    words = m.groupBy("doc_id").agg(F.sum(F.size(F.split("text", " "))).alias("n")).toPandas().set_index("doc_id").n
    assert (words.reindex(t[t > 0].index) == t[t > 0]).all()
    assert mixing.taken(d.limit(0)).count() == 0 and mixing.mixed_documents(d.limit(0)).count() == 0 and mixing.shards(d.limit(0)).count() == 0


def test_mix_of_repeated_and_null_ids(spark):
    """Each row has words of its own, whatever ids it shares; a long text and white space of all kinds."""
    texts = [(7, prose(1, 300)), (7, prose(2, 500)), (None, prose(3, 400)), (None, prose(4, 90)), (9, prose(5, 200)), (9, prose(5, 200)), (11, prose(6, 20_000).replace(" ", "\n\t ")), (12, None)]
    d = docs(spark, texts, ["a", "b"])
    t = mixing.taken(d).toPandas()
    assert len(t) == 8 and (t.taken <= 3 * t["size"]).all()
    m = mixing.mixed_documents(d).toPandas()
    assert sum(len(x.split()) for x in m.text) == t.taken.sum()
    took = t.assign(d=t.doc_id.fillna(-1)).groupby("d").taken.sum()
    held = m.assign(d=m.doc_id.fillna(-1), n=[len(x.split()) for x in m.text]).groupby("d").n.sum()
    assert (held.reindex(took[took > 0].index) == took[took > 0]).all()


def test_shards_are_multinomial_draws(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD", 32)
    d = docs(spark, [prose(i, 200 + i % 90) for i in range(300)], ["a", "b", "c"])
    s = mixing.shards(d).toPandas()
    t = mixing.taken(d).toPandas()
    assert sum(len(x.split(" ")) for x in s.text) == t.taken.sum() and s.text.map(lambda x: len(x.split(" "))).max() == mixing.BLOCK
    assert (s.groupby("shard").size().iloc[:-1] == 32).all() and not s.duplicated(["shard", "slot"]).any()
    # counts per shard scatter as draws do: their variance is near n p (1 - p)
    counts = s.groupby(["shard", "source"]).size().unstack(fill_value=0).iloc[:-1]
    share = counts.sum() / counts.sum().sum()
    assert (counts.std() > 0.7 * np.sqrt(32 * share * (1 - share))).all() and (counts.std() < 1.4 * np.sqrt(32 * share * (1 - share))).all()
    # no block comes again before all blocks of its source came
    for _, x in s.sort_values(["shard", "slot"]).groupby("source"):
        n = x.block.nunique()
        assert x.block.iloc[:n].is_unique and x.epoch.is_monotonic_increasing or len(x) >= n
    assert s.groupby(["source", "block"]).size().max() <= 3


# ---- BPE and token files

ODD = ["", None, " ", "a", "  two  spaces ", "line\n\n three", "tab\tx", "<|endoftext|>", "a<|endoftext|>b <|endoftext|>", "naïve café", "漢字かな 한글 🙂👍🏽", "  x　", "it's we'll I'D", "x" * 5000, "=-" * 700, " " * 900 + "z", "\x00\x1c\x85"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def test_bpe_equals_the_library(spark, library):
    texts = ODD + [prose(3, 400)] * 2
    got = {r.doc_id: r for r in bpe.digests(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(back)), repr(t)


def test_bpe_round_trip(spark):
    d = docs(spark, ODD)
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(d)).collect()}
    assert back == {i: t or "" for i, t in enumerate(ODD)}
    assert bpe.encode(d.limit(0)).count() == 0


def test_random_text_by_pieces(library):
    r = random.Random(5)
    codec = bpe.ByteBPE(bpe.default_path())
    codec.words.room = 3000
    letters = list("abcXYZ  \n\t.,'é漢🙂0123_-") + ["'ll", " ", "<|endoftext|>"]
    texts = ["".join(r.choices(letters, k=r.randint(0, 50))) for _ in range(800)]
    for t, ids in zip(texts, codec.lists(texts), strict=True):
        assert ids.as_py() == library.encode(t, add_special_tokens=False).ids
    assert codec.decoded(codec.lists(texts)) == texts
    assert 5 < len(codec.words.table) <= 25 and 0 <= codec.words.room < 200
    assert all("".join(map(pieces.piece_of, pieces.keys_of(t))) == t for t in texts)


def test_token_shards(spark, library):
    texts = ODD + [(3, "again"), (None, "no id"), (7, prose(1, 300))]
    d = docs(spark, texts)
    rows = d.withColumn("h", F.xxhash64("text")).toPandas().sort_values(["doc_id", "h"], na_position="first", kind="stable")
    manifest = tokenfile.write(d, shard_ids=500)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokenfile.read(manifest).collect()), key=lambda r: r[0])
    at, want = 0, []
    for i, t in zip(rows.doc_id, rows.text):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want.append((at, None if i != i else int(i), len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    assert manifest.agg(F.max("ids")).first()[0] > 500  # a long document is a shard of its own
    assert tokenfile.read(tokenfile.write(d.limit(0))).count() == 0


def test_long_words_by_themselves(library):
    codec = bpe.ByteBPE(bpe.default_path())
    r = random.Random(6)
    words = ["x" * 100_000, "".join(r.choices("abcdefgh", k=9000)), "ab" * 5000, "é" * 4000, "thethere" * 1000]
    assert [x.as_py() for x in codec.lists(words)] == [library.encode(w, add_special_tokens=False).ids for w in words]


@pytest.mark.parametrize("n", [1, 9, 3000, tokenfile.BLOCK, 300_000])
def test_wavelet_matrix(n):
    ids = np.minimum(np.random.default_rng(1).zipf(1.3, n), 50256).astype(np.uint32)
    ids[5:2900:11] = 42
    data = tokenfile.Shard.of(ids, np.array([9]), np.array([n])).to_bytes()
    s = tokenfile.Shard.from_bytes(data)
    assert (s.ids() == ids).all() and s.doc_ids.tolist() == [9] and s.ends.tolist() == [n]
    assert all(s.access(i) == ids[i] for i in {*range(0, n, max(1, n // 30)), n - 1})
    assert s.rank(42) == (ids == 42).sum() and s.rank(42, n // 3) == (ids[: n // 3] == 42).sum() and s.rank(10**6) == 0
    for token in (42, 1, int(ids[-1]), 50256):
        places = np.flatnonzero(ids == token).tolist()
        assert s.occurrences(token) == places
        assert all(s.select(token, j) == places[j] for j in {0, len(places) // 2, len(places) - 1} if places)
    with pytest.raises(IndexError):
        s.select(42, n)
    assert n < 9000 or len(data) < 2 * n  # less than 16 bits an id


# ---- WARC

def test_warc(spark):
    big, other = "<p>" + "é" * 100, "x" * 99
    pages = [(5, "http://a/é b", big), (2, "u", big), (9, None, big), (1, "u", other), (3, "u", other), (4, "u", None), (6, "u", ""), (7, "u", "long " * 50000), (None, "u", big)]
    p = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("_first", F.lit(1)).withColumn("at", F.lit(2))
    got = {r.page_id: r for r in warc.read(warc.normalise(warc.write(p))).collect()}
    assert len(got) == 9
    for i, _, h in pages:
        raw = (h or "").encode()
        first = 2 if h == big and i != 2 else None
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == (len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if first else "response", first)
    assert warc.read(warc.normalise(warc.write(p.limit(0)))).count() == 0


def test_warc_of_repeated_ids_and_its_sidecars(spark):
    big = "<p>" + "b" * 200
    pages = [(1, "u", big), (1, "u", big), (2, "u", big), (None, "u", big), (None, None, "n" * 150), (None, None, "n" * 150), (3, "u", "t" * 2_000_000)]
    m = warc.normalise(warc.write(spark.createDataFrame(pages, "page_id long, url string, html string")))
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read(m).collect()), key=str)
    assert got == sorted([(1, "response", None, 203), (1, "response", None, 203), (2, "revisit", 1, 203), (None, "revisit", 1, 203), (None, "response", None, 150), (None, "response", None, 150), (3, "response", None, 2_000_000)], key=str)
    entries = {(r.file, r.at): r.size for r in warc.indexed(m).collect()}
    assert len(entries) == 7
    with pytest.raises(Exception, match="1 records are missing"):
        warc.indexed(m.withColumn("records", F.col("records") + 1)).count()


def test_records_of_any_cut():
    import gzip
    import io

    recs = [warc.record(i, "u", b"p" * n, None) for i, n in enumerate((0, 10, 5000, 3))]
    whole = gzip.compress(b"".join(recs))
    members = b"".join(map(gzip.compress, recs))
    for data in (whole, members):
        for block in (1, 7, 100, 1 << 20):
            assert list(warc.records_of(io.BytesIO(data), block)) == recs
    with pytest.raises(ValueError):
        list(warc.records_of(io.BytesIO(gzip.compress(b"".join(recs)[:-9]))))


# ---- near duplicates

def brute(texts):
    import re

    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def edited(seed, text, n):
    r = random.Random(seed)
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.random()}"
    return " ".join(w)


def near_pairs(found, texts):
    """Components and set sizes against brute force."""
    want = brute(dict(enumerate(texts)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()}
    assert got == want
    return want


@pytest.mark.parametrize("block, rounds", [(minhash.BLOCK, minhash.ROUNDS), (3, 0)])
def test_near_duplicates(spark, monkeypatch, block, rounds):
    for name, value in (("BLOCK", block), ("TEXTS", min(block, minhash.TEXTS)), ("ROUNDS", rounds)):
        monkeypatch.setattr(minhash, name, value)
    base = [prose(i, 200) for i in range(6)]
    shared = prose(99, 80)
    texts = [None, "", " ", "one two", "ONE two", "One Two three", *base]
    texts += [edited(i, base[i % 3], i % 9) for i in range(60)] + [base[1]] * 5
    texts += [prose(200 + i, 60) + " " + shared for i in range(30)]
    want = near_pairs(minhash.near_duplicates(docs(spark, texts)), texts)
    if not rounds:
        return
    kept = minhash.kept_documents(docs(spark, texts)).select("doc_id").toPandas().doc_id
    assert sorted(kept) == sorted(i for i, (_, c) in want.items() if c == i)


def test_buckets_of_the_same_classes_are_compared_once(spark):
    rows = [(k, i, i) for k, ids in ((5, (1, 2)), (3, (1, 2)), (9, (2, 1)), (4, (1, 2, 3)), (6, (7,))) for i in ids]
    got = {(r.key, r.id) for r in minhash.once(spark.createDataFrame(rows, "key long, id long, comp long")).collect()}
    assert got == {(3, 1), (3, 2), (4, 1), (4, 2), (4, 3), (6, 7)}


def test_two_texts_are_compared_in_little_memory():
    import tracemalloc

    import pyarrow as pa

    texts = [edited(i, prose(3, 300), i) for i in range(2)]
    two = pa.table({"id": [1, 2], "comp": [1, 2], "i": [0, 0], "p": [0, 0], "q": [0, 0], "text": texts}).combine_chunks().to_batches()[0]
    tracemalloc.start()
    assert minhash.joining(two)
    assert tracemalloc.get_traced_memory()[1] < 1 << 22
    tracemalloc.stop()


def test_near_copies_without_their_original(spark):
    """Copies of one text with other words changed: most pairs are just below the threshold, some just above."""
    base = prose(7, 120)
    texts = [edited(i, base, 3) for i in range(300)] + [prose(300, 30_000), prose(300, 30_000) + " more"]
    near_pairs(minhash.near_duplicates(docs(spark, texts)), texts)


def test_small_sets_at_the_threshold(spark):
    """Three and four shingles, one more or less: exactly 0.75; seven at most."""
    texts = [t for i in range(120) for t in (prose(i, 7), prose(i, 7) + f" end{i}")] + [prose(500, 11), prose(500, 10)]
    near_pairs(minhash.near_duplicates(docs(spark, texts)), texts)


def test_near_duplicates_odd_ids(spark):
    a, b = prose(1, 60), prose(2, 60)
    d = docs(spark, [(4, a), (4, b), (7, b), (9, a), (None, a), (None, ""), (None, prose(3, 60)), (None, prose(3, 60)), (12, prose(4, 60)), (12, prose(4, 60))])
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_shingles > 0, r.component_id) for r in minhash.near_duplicates(d).collect()), key=str)
    assert got == sorted([(False, 4, True, 4), (False, 4, True, 4), (False, 7, True, 4), (False, 9, True, 4), (True, 0, True, 4), (True, 0, False, None), (True, 0, True, None), (True, 0, True, None), (False, 12, True, 12), (False, 12, True, 12)], key=str)
    kept = sorted(((r.doc_id, r.text) for r in minhash.kept_documents(d).collect()), key=str)
    assert kept == sorted([(4, min((a, b), key=lambda t: [r.h for r in d.where(F.col("text") == t).select(F.xxhash64("text").alias("h")).limit(1).collect()])), (12, prose(4, 60)), (None, ""), (None, prose(3, 60))], key=str)
    assert minhash.near_duplicates(d.limit(0)).count() == 0 and minhash.kept_documents(d.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 150), (7, 7), (3, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 150: 100, 200: 100}


# ---- lines

def test_line_dedup(spark):
    long_line = prose(5, 55)
    texts = ["a\nb\nc\nd", "x\na\n\nb\nc\ny", None, "", "a\nb", "p\n" + long_line + "\nq", "r\n" + long_line, "m\nm\nm\nm\nm", "a\r\nb\nc"]
    got = {r.doc_id: (r.text, r.removed_lines) for r in linededup.dedup(docs(spark, texts)).collect()}
    assert got[0] == (texts[0], 0) and got[1] == ("x\ny", 4) and got[2] == (None, 0) and got[3] == ("", 0) and got[4] == ("a\nb", 0)
    assert got[5][1] == 0 and got[6] == ("r", 1) and got[7] == ("m", 4) and got[8] == ("", 3)
    assert linededup.dedup(docs(spark, texts).limit(0)).count() == 0


# ---- vectors

def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit("x")).withColumn("id", F.lit(1))


def test_top_k(spark):
    r = np.random.default_rng(3)
    x = (r.standard_normal((400, 8)) * r.uniform(0.1, 2, (400, 1))).round(2).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, None), (450, [1.0, None] * 4), (500, [float("nan")] * 8), (550, [float("inf")] * 8)]
    got = topk.top_k(vectors(spark, rows)).orderBy("query_id", "rank").collect()
    y, want = np.floor(256 * x.astype(float)), []
    for q in range(0, 400, 50):
        s = y @ y[q]
        s[q] = -np.inf
        want += [(q, k + 1, int(j), int(s[j])) for k, j in enumerate(np.lexsort((np.arange(400), -s))[:5])]
    assert [tuple(g) for g in got] == want
    few = topk.top_k(vectors(spark, [(50, [1.0, 2.0]), (100, [1.0]), (3, [])])).orderBy("query_id", "rank").collect()
    assert [tuple(g) for g in few] == [(50, 1, 100, 65536), (50, 2, 3, 0), (100, 1, 50, 65536), (100, 2, 3, 0)]
    assert topk.top_k(vectors(spark, rows).limit(0)).count() == 0


def test_top_k_in_strata(spark, monkeypatch):
    """Lengths of many sizes, many of one, and blocks of few vectors; queries and candidates that share an id."""
    r = np.random.default_rng(5)
    x = (r.standard_normal((900, 6)) * np.where(np.arange(900) % 3 == 0, 1.0, r.uniform(0.01, 3, 900))[:, None]).round(2).astype(np.float32)
    x[300:500] = x[300]
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(None, [9.0] * 6)]
    got = topk.top_k(vectors(spark, rows)).orderBy("query_id", "rank").collect()
    y, want = np.floor(256 * x.astype(float)), []
    for q in range(0, 900, 50):
        s = y @ y[q]
        s[q] = -np.inf
        want += [(q, k + 1, int(j), int(s[j])) for k, j in enumerate(np.lexsort((np.arange(900), -s))[:5])]
    assert [tuple(g) for g in got] == want
    same = [(50, [1.0, 0.0]), (50, [0.0, 2.0]), (7, [1.0, 1.0]), (7, [1.0, 3.0]), (8, [-1.0, -1.0])]
    got = topk.top_k(vectors(spark, same)).orderBy("query_id", "rank").collect()
    # of rows that share a query's id the smallest vector asks; candidates are all rows of other ids
    assert [tuple(g) for g in got] == [(50, 1, 7, 3 * 2 * 65536), (50, 2, 7, 2 * 65536), (50, 3, 8, -2 * 65536)]


def test_top_k_of_large_components(spark):
    rows = [(i, [4e5 + i, -3e5 + 7 * i] * 32) for i in range(101)] + [(200, [3e38] * 64)]
    got = [tuple(g) for g in topk.top_k(vectors(spark, rows)).orderBy("query_id", "rank").collect()]
    v = {i: [int(np.floor(256 * float(np.float32(c)))) for c in x] for i, x in rows}
    want = []
    for q in (0, 50, 100, 200):
        s = sorted(((-sum(a * b for a, b in zip(v[q], v[i])), i) for i in v if i != q))[:5]
        want += [(q, k + 1, i, max(-(2**63), min(2**63 - 1, -p))) for k, (p, i) in enumerate(s)]
    assert got == want


def test_nn_descent(spark):
    r = np.random.default_rng(4)
    x = r.standard_normal((600, 32))
    x[100:160] = x[100] + 0.05 * r.standard_normal((60, 32))
    for i in range(200, 240, 2):
        x[i + 1] = x[i] + 0.03 * r.standard_normal(32)
    x[300:310] = x[300]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 32), (902, [float("nan")] * 32), (903, [1.0]), (904, [])]
    got = {g.vec_id: g for g in nndescent.near_duplicates(vectors(spark, rows)).collect()}
    y = x.astype(np.float32).astype(float)
    y /= np.linalg.norm(y, axis=1)[:, None]
    near = y @ y.T >= 0.95
    np.fill_diagonal(near, False)
    assert all(got[i].n_links == near[i].sum() for i in range(600))
    assert all(got[i].component_id == 100 for i in range(100, 160)) and got[201].component_id == 200 and not got[201].kept and got[309].component_id == 300
    assert all(got[i].n_links == 0 and got[i].kept for i in range(900, 905))
    assert nndescent.near_duplicates(vectors(spark, rows).limit(0)).count() == 0


def test_nn_descent_of_odd_rows(spark):
    """Null, repeated and differently long rows, huge and tiny components, and equal vectors."""
    rows = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (9, [0.0, 3.0]), (None, [0.0, 1.0]), (7, [0.0, 2.0, 0.0]), (8, [1e-30, 1e-30]), (3, [3e38, 3e38]), (4, [1.0, None]), (6, [2.0, 2.0]), (6, [2.0, 2.0])]
    got = sorted(((g.vec_id, g.n_links, g.component_id, g.kept) for g in nndescent.near_duplicates(vectors(spark, rows)).collect()), key=str)
    # the least vector of id 5 is (0, 1): it links with 9; 3, 6 and 8 are one direction
    assert got == sorted([(5, 1, 5, True), (5, 1, 5, True), (9, 1, 5, False), (None, 0, None, True), (7, 0, 7, True), (8, 2, 3, False), (3, 2, 3, True), (4, 0, 4, True), (6, 2, 3, False), (6, 2, 3, False)], key=str)


def test_saturated_lists_are_enlarged(spark):
    e = [(0, i, 0.99 - i / 1000) for i in range(1, 30)] + [(100, 100 + i, 0.96 - i / 100) for i in range(1, 30)]
    n = {r.a: r.n for r in nndescent.lists(spark.createDataFrame(e, "a long, b long, s double")).groupBy("a").agg(F.count("*").alias("n")).collect()}
    assert n[0] == nndescent.WIDE and n[100] == nndescent.LIST


def at_cosine(r, x, c):
    """A unit vector at cosine c of the unit vector x."""
    y = r.standard_normal(len(x))
    y -= (y @ x) * x
    return c * x + np.sqrt(1 - c * c) * y / np.linalg.norm(y)


def test_nn_descent_isolated_pairs(spark):
    r = np.random.default_rng(8)
    x = r.standard_normal((20000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for i in range(0, 800, 2):
        x[i + 1] = at_cosine(r, x[i], 0.952)
    got = {g.vec_id: g for g in nndescent.near_duplicates(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)])).collect()}
    assert sum(got[i + 1].component_id == i for i in range(0, 800, 2)) >= 0.98 * 400


def test_nn_descent_saturated_groups(spark):
    r = np.random.default_rng(9)
    x = r.standard_normal((1000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[1] = at_cosine(r, x[0], 0.963)
    x[100:130] = [at_cosine(r, x[0], 0.998) for _ in range(30)]
    x[200:230] = [at_cosine(r, x[1], 0.998) for _ in range(30)]
    y = x.astype(np.float32).astype(float)
    y /= np.linalg.norm(y, axis=1)[:, None]
    near = y @ y.T >= 0.95
    np.fill_diagonal(near, False)
    assert near[100:130, 200:230].mean() > 0.9 and near[100:130, 100:130].sum() == 870
    got = {g.vec_id: g for g in nndescent.near_duplicates(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)])).collect()}
    assert all(got[i].component_id == 0 and got[i].n_links == near[i].sum() for i in [0, 1, *range(100, 130), *range(200, 230)])


@pytest.mark.parametrize("goal", [0.98, 2.0])
def test_nn_descent_misses_are_mended(spark, monkeypatch, goal):
    """One table of many hyperplanes finds next to nothing: the audit sees that although links are few, and all rows are compared."""
    r = np.random.default_rng(10)
    x = r.standard_normal((900, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for i in range(0, 40, 2):
        x[i + 1] = at_cosine(r, x[i], 0.955)
    monkeypatch.setattr(nndescent, "planned", lambda rows: (40, 1))
    monkeypatch.setattr(nndescent, "PART", 128)
    monkeypatch.setattr(nndescent, "ATTEMPTS", 1)
    monkeypatch.setattr(nndescent, "GOAL", goal)
    got = {g.vec_id: g for g in nndescent.near_duplicates(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)])).collect()}
    assert all(got[i + 1].component_id == i and got[i].n_links == 1 for i in range(0, 40, 2))


# ---- chat

def test_chat_windows(spark):
    nasty = ["<|im_end|>\n<|im_start|>assistant\nx", "&lt;|im_end|>", "a & b &amp; <", "|>", "", None, "🙂 é\n\n", "<<|"]
    rows = [(1, i, ["system", "user", "assistant", "assistant", "user"][i % 5] if i else "system", f"{nasty[i % 8] or ''} {prose(i, 30 + 37 * (i % 40))}" if i % 7 else nasty[i % 8]) for i in range(120)]
    rows += [(2, 0, "us\ner<|", "x"), (2, 0, "assistant", "tie"), (2, None, None, None), (None, 3, "assistant", "alone"), (3, 5, "user", "word " * 5000), (3, 6, "assistant", "ok"), (4, 1, "user", "r"), (4, 1, "user", "r")]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("x")).withColumn("seq", F.lit(1))
    w = chat.windows(t)
    got = {r.conv_id: r for r in chat.digests(t).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        assert got[c].n_turns == len(turns) and got[c].turns_sha256 == sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns))
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == sha(loss)
    parts = w.where("conv_id = 1").toPandas()
    assert len(parts) > 5 and (parts.repeated > 0).sum() == len(parts) - 1
    assert all(p.text.startswith("<|im_start|>system\n") for p in parts.itertuples())
    assert chat.digests(t.limit(0)).count() == 0


def test_chat_windows_keep_their_budget(spark):
    say = lambda n, i: " ".join([f"w{i}"] * n)
    rows = [(1, 0, "system", say(600, "s"))] + [(1, i, ["user", "assistant"][i % 2], say(40, i)) for i in range(1, 40)]
    rows += [(2, i, ["user", "assistant"][i % 2], say(1 + 37 * i % 300, i)) for i in range(80)] + [(2, 30, "system", say(100, "s")), (2, 90, "user", say(3000, "long")), (2, 91, "assistant", "short")]
    rows += [(3, 0, "system", say(5000, "s")), (3, 1, "user", "a"), (3, 2, "assistant", "b")]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    tokens = lambda text: [len(x.split("\n", 1)[1].split()) + chat.MARKS for x in text.split("<|im_end|>\n")[:-1]]
    w = chat.windows(t).orderBy("conv_id", "window").collect()
    for r in w:
        n = tokens(r.text)
        assert len(n) == r.repeated + r.turns and "<|im_start|>system\n" in r.text
        assert sum(n) <= chat.BUDGET or r.turns == 1 and r.repeated <= 1, (r.conv_id, r.window, sum(n))
    # windows are not of single turns where turns are short
    assert sum(r.turns == 1 for r in w if r.conv_id == 1) <= 2 and len([r for r in w if r.conv_id == 1]) <= 15
    got = {r.conv_id: r for r in chat.digests(t).collect()}
    assert [got[c].n_turns for c in (1, 2, 3)] == [40, 83, 3]


# ---- toxicity

def test_toxicity(spark):
    r = random.Random(2)
    bad = ["wretchx", "vilequ", "scornfa"]
    texts, toxic = [], []
    for i in range(1500):
        w = prose(i, r.randint(5, 120)).split()
        is_bad = i % 8 == 0
        for _ in range(3 * is_bad):
            w.insert(r.randrange(len(w)), r.choice(bad) + r.choice(["", "ly", "ness", "!"]))
        texts.append(" ".join(w))
        toxic.append(int(is_bad))
    d = docs(spark, [*texts, None, "", (None, "vilequ scornfa")])
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(toxic) if i % 2 == 0], "doc_id long, toxic int").withColumn("text", F.lit("x"))
    out = toxicity.scored(d, labels).toPandas()
    assert len(out) == 1503 and out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.5)).all()
    x = out[out.doc_id < 1500].sort_values("doc_id")
    assert (x.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in range(1500)]).all()
    held = x[x.held_out]
    assert (held.predicted == [toxic[int(i)] for i in held.doc_id]).mean() > 0.97
    kept = toxicity.clean_documents(d.select("doc_id", "text", "lang", "source", "n_chars"), labels)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and kept.count() == (out.predicted == 0).sum()
    assert (toxicity.scored(d, labels.limit(0)).toPandas().score == 0).all() and toxicity.scored(d.limit(0), labels).count() == 0


def least_risk(pos, unl, prior):
    """300 steps of Adam down the corrected risk, whose slope is taken from the losses one by one."""
    w, m, v = np.append(np.zeros(pos.shape[1] - 1), math.log(prior / (1 - prior))), 0, 0
    sigma = lambda x: 1 / (1 + np.exp(-x))
    mean = lambda x, slope: (x * slope[:, None]).mean(0)
    for t in range(1, 301):
        gp, gu = pos @ w, unl @ w
        rest = np.log1p(np.exp(gu)).mean() - prior * np.log1p(np.exp(gp)).mean()
        of_rest = mean(unl, sigma(gu)) - prior * mean(pos, sigma(gp))
        slope = (prior * mean(pos, sigma(gp) - 1) + of_rest if rest >= 0 else -of_rest) + 1e-4 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope * slope
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def test_scores_by_brute_force(spark):
    """Learning and scoring once more, in plain Python over all rows, from what the module says that it does."""
    texts = {i: prose(i, 5 + i % 50) + (" vilequ scornfa wretchx" if i % 6 == 0 else "") for i in range(700)}
    labels = {i: int(i % 6 == 0) for i in range(0, 700, 2)}
    rows = [*texts.items(), (3, "another text of three"), (None, "vilequ"), (800, None), (801, "Vilequ! " * 20_000), (802, " ".join(f"vilequ{i}" for i in range(1000)))]
    got = {}
    for r in toxicity.scored(docs(spark, rows), spark.createDataFrame([*labels.items(), (6, 0)], "doc_id long, toxic int")).collect():
        got.setdefault(r.doc_id, []).append(r.score)

    def bag(t):
        out = {}
        for w in {*(t or "").lower().split()}:
            w = w.strip(toxicity._OUTER)
            for x in ([f"={w}"] + [w[:n] for n in range(3, 7) if len(w) >= n]) if w else []:
                f = zlib.crc32(x.encode()) % 2**toxicity.BITS
                out[f] = out.get(f, 0) + 1
        return out

    learn = {i: min(t, "another text of three") if i == 3 else t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5} | ({800: None} if zlib.crc32(b"800") % 5 else {}) | ({i: t for i, t in rows[-2:] if zlib.crc32(str(i).encode()) % 5})
    pos, unl = [bag(learn[i]) for i in sorted(learn) if labels.get(i)], [bag(learn[i]) for i in sorted(learn)]
    known = [1 for i, t in labels.items() if zlib.crc32(str(i).encode()) % 5 and t]
    total = sum(1 for i in labels if zlib.crc32(str(i).encode()) % 5) + (zlib.crc32(b"6") % 5 > 0)
    z = {}
    for f in {f for b in unl for f in b} | {f for b in pos for f in b}:
        p, u = sum(f in b for b in pos), sum(f in b for b in unl)
        share = (p + u) / (len(pos) + len(unl))
        if p + u >= 5:
            z[f] = (p / len(pos) - u / len(unl)) / math.sqrt(max(share * (1 - share), 1e-12) * (1 / len(pos) + 1 / len(unl)))
    chosen = sorted(f for f in sorted(z, key=lambda f: (-abs(z[f]), f))[: toxicity.FEATURES] if abs(z[f]) > toxicity.SURE)
    dense = lambda bags: np.array([[math.log1p(b.get(f, 0)) for f in chosen] + [1.0] for b in bags], np.float32)
    w = least_risk(dense(pos).astype(float), dense(unl).astype(float), len(known) / total)
    for i, t in rows:
        b = bag(t)
        g = sum(x * math.log1p(b.get(f, 0)) for f, x in zip(chosen, w)) + w[-1]
        assert min(abs(s - 1 / (1 + math.exp(-g))) for s in got[i]) < 2e-3, (i, got[i])
    assert sum(map(len, got.values())) == len(rows)


def test_risk_stays_non_negative():
    r = np.random.default_rng(0)
    pos = np.c_[r.standard_normal((50, 200)) + 0.3, np.ones(50)].astype(np.float32)
    unl = np.c_[r.standard_normal((300, 200)), np.ones(300)].astype(np.float32)
    w = toxicity.fit(pos, unl, 0.2, steps=100)
    assert np.isfinite(w).all() and (unl @ w > 0).mean() < 0.5
