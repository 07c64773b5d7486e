"""Mixing sources to target weights, in SQL functions only.

The words of a source form one stream (documents by a fixed bucket of doc_id, then doc_id), which is cut into blocks of
a fixed number of words; the last block of a source may be short.  A source gets tickets, one per block it may place,
so many that its words come to its target.  The output is a row of shards of SHARD slots.  Each slot draws its source at
random with the sources' tickets as weights, so the counts of sources in a shard are a multinomial draw.  Left alone, the
totals would scatter around the targets and overshoot the limit of three copies; so the slots that a source draws beyond
its tickets, some square root of all and from all over the output, go to the tickets of sources that drew too few.  A source's k-th slot, counted over
all shards, takes block p_e(k mod n) of the source, where p_e is the pseudorandom permutation of epoch e = k div n.  So no
block comes again before all blocks came, nothing is gathered anywhere, and blocks meet slots in an equi-join by (source,
block).  ``shards`` puts the words of the blocks into the slots.

Permutations are swap-or-not ciphers (Hoang, Morris, Rogaway 2012) in 31-bit arithmetic: bijections of any 0..n-1
without tables, and the same on each run and in any SQL engine.

Defined results: null or empty texts have size 0, are in no block and take 0 words; texts of any length are taken whole; a
null source is one source, the last; rows that share a doc_id, or have none, are separate rows with words of their own,
equal rows too (which of them gets which words does not matter); an empty table gives an empty mix; other columns take no
part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import DOC_COLUMNS, WORD, columns_of, id_bucket, running_start, shuffle_partitions, written

#: Weights by rank of the source, repeating; the most copies of a source.
WEIGHTS, MOST = (5, 2, 1), 3
#: Words in a block; slots in an output shard; rounds of a permutation; buckets that order a source's stream.
BLOCK, SHARD, ROUNDS, BUCKETS = 64, 4096, 8, 4096
#: Tickets that a draw looks for its source among; shards whose slots are counted together; what hashes are below.
TICKETS, TOGETHER, PRIME = 1024, 64, 2147483647


_HASHED = f"((({{0}}) % {PRIME}) * (({{0}}) % {PRIME}) % {PRIME} * 48271 + ({{0}}) % {PRIME}) % {PRIME}"


def permuted(x: str, n: str, key: str, rounds: int = ROUNDS) -> Column:
    """Where the pseudorandom permutation of 0..n-1 that ``key`` picks takes x (all three SQL expressions of longs).

    A round maps x to its mirror image y = (h - x) mod n, or leaves it, by a bit that x and y share.
    """
    keys = f"transform(sequence(1L, {rounds}L), r -> (({key}) % {PRIME} + 7919 * r))"
    keys = f"transform({keys}, z -> {_HASHED.format('z')})"
    y = f"(h % ({n}) + ({n}) - x) % ({n})"
    bit = f"{_HASHED.format(f'(greatest(x, {y}) + h)')} div 1024 % 2"
    return F.expr(f"aggregate({keys}, ({x}), (x, h) -> if({bit} = 1, {y}, x))")


def keyed(docs: DataFrame) -> DataFrame:
    """Add _k1 and _k2, together 128 bits of doc_id, source and text: the same for equal rows only."""
    return docs.withColumns({"_k1": F.xxhash64("doc_id", "source", "text"), "_k2": F.xxhash64(F.lit(2), F.col("doc_id").isNull(), F.col("source").isNull(), "text", "source", "doc_id")})


def placed(docs: DataFrame) -> DataFrame:
    """(doc_id, source, _k1, _k2, size, start): each row's words and where they begin in its source's stream."""
    # written first: the running sums below read it twice, and texts are not counted twice
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    sized = written(keyed(columns_of(docs, "doc_id", "source", "text")).select("doc_id", "source", "_k1", "_k2", words))
    return written(running_start(sized, ["source"], [F.col("doc_id"), F.col("size"), F.col("_k1"), F.col("_k2")], id_bucket("doc_id", BUCKETS), "size", "start"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: float = MOST) -> DataFrame:
    """From (source, source_size), one row a source, add rank, target, blocks, tickets, and first ticket.

    target is the smaller of most * source_size and level * weight; the level is found where the sources in the order of
    (limit / weight) stop being at their limit, which is what resharing the excess until none is above leads to.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    t = sizes.withColumn("rank", F.row_number().over(every).cast("long") - 1)
    t = t.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    t = t.withColumns({"_cap": F.col("source_size") * float(most), "_all": F.sum("source_size").over(Window.partitionBy()).cast("double")})
    by_level = Window.orderBy(F.col("_cap") / F.col("_w"), "rank")
    before, onward = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    t = t.withColumn("_level", (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(onward))
    t = t.withColumn("_level", F.max(F.when(F.col("_cap") / F.col("_w") > F.col("_level"), F.col("_level"))).over(Window.partitionBy()))
    t = t.withColumn("target", F.coalesce(F.least(F.col("_cap"), F.col("_level") * F.col("_w")), F.lit(0.0)))
    t = t.withColumn("blocks", F.ceil(F.col("source_size") / BLOCK))
    t = t.withColumn("tickets", F.when(F.col("source_size") > 0, F.least(F.floor(most * F.col("blocks")), F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + 0.5))).otherwise(0).cast("long"))
    t = t.withColumns({"first_ticket": F.coalesce(F.sum("tickets").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "all_tickets": F.sum("tickets").over(Window.partitionBy())})
    return t.select("source", "source_size", "rank", "target", "blocks", "tickets", "first_ticket", "all_tickets")


def draws(sources: DataFrame, seed: int = 1) -> DataFrame:
    """(shard, slot, rank, tickets, blocks): each slot's source, drawn by the sources' tickets; a written table."""
    spark = sources.sparkSession
    total = sources.agg(F.max("all_tickets")).first()[0] or 0
    s = spark.range(0, total, 1, shuffle_partitions(spark)).withColumn("_h", F.expr(_HASHED.format(_HASHED.format(f"(id % {PRIME} + id div {PRIME} * 7919 + {seed} * 104723)"))))
    s = s.withColumn("_g", F.expr(_HASHED.format("_h + 12345")))
    s = s.withColumn("_at", F.expr(f"least(cast(floor((_h + _g / {PRIME}D) / {PRIME}D * {total}D) as long), {total - 1}L)")).withColumn("_part", F.expr(f"_at div {TICKETS}"))
    t = sources.where("tickets > 0").withColumn("_part", F.explode(F.expr(f"sequence(first_ticket div {TICKETS}, (first_ticket + tickets - 1) div {TICKETS})")))
    t = t.select(F.col("_part").alias("_of"), "rank", "tickets", "blocks", "first_ticket")
    # both sides grow with the data, though one comes from a small table: never broadcast
    found = s.hint("merge").join(t.hint("merge"), (F.col("_part") == F.col("_of")) & F.expr("_at >= first_ticket and _at < first_ticket + tickets"))
    return written(found.select(F.expr(f"id div {SHARD}").alias("shard"), F.expr(f"id % {SHARD}").alias("slot"), "rank", "tickets", "blocks"))


def shard_counts(drawn: DataFrame) -> DataFrame:
    """(rank, shard, n, before): how many slots a source drew in a shard, and in all shards before it."""
    return running_start(drawn.groupBy("rank", "shard").agg(F.count("*").alias("n")), ["rank"], [F.col("shard")], F.expr(f"shard div {TOGETHER}"), "n", "before")


def slots(sources: DataFrame, seed: int = 1) -> DataFrame:
    """(shard, slot, rank, epoch, block): one row for each slot of the output."""
    drawn = draws(sources, seed)
    counts = shard_counts(drawn)
    had = drawn.groupBy(F.col("rank").alias("_r")).agg(F.count("*").alias("had"))
    counts = written(counts.join(had, F.col("rank") == F.col("_r")).select(F.col("rank").alias("_r"), F.col("shard").alias("_s"), "n", "before", "had"))
    nth = Window.partitionBy("shard", "rank").orderBy("slot")
    numbered = drawn.join(counts, (F.col("shard") == F.col("_s")) & (F.col("rank") == F.col("_r"))).withColumns({"j": F.col("before") + F.row_number().over(nth) - 1, "over": F.expr("greatest(had - tickets, 0L)")})
    # what was drawn beyond a source's tickets is taken from all over its draws
    numbered = written(numbered.select("shard", "slot", "rank", "blocks", F.expr("(j + 1) * over div had > j * over div had").alias("free"), F.expr("j - j * over div had").alias("k")))
    one, first = F.lit(1).cast("long").alias("one"), F.sum("n").alias("had")
    free = running_start(numbered.where("free").select("shard", "slot", one), [], [F.col("shard"), F.col("slot")], F.expr(f"shard div {TOGETHER}"), "one", "m").select("shard", "slot", "m")
    # and goes to the tickets that were not drawn, those of all sources in turn
    lack = sources.where("tickets > 0").join(counts.groupBy("_r").agg(first), F.col("rank") == F.col("_r"), "left").withColumn("had", F.coalesce("had", F.lit(0))).where("had < tickets")
    lack = lack.withColumn("i", F.explode(F.expr("sequence(0L, tickets - had - 1)"))).select("rank", (F.col("had") + F.col("i")).alias("k"), "blocks", F.expr("(2 * i + 1) / (2D * (tickets - had))").alias("turn"), one)
    lack = running_start(lack, [], [F.col("turn"), F.col("rank")], F.floor(F.col("turn") * 1024), "one", "_m").drop("one", "turn")
    lent = free.hint("merge").join(lack.hint("merge"), F.col("m") == F.col("_m")).select("shard", "slot", "rank", "k", "blocks")
    every = numbered.where("not free").select("shard", "slot", "rank", "k", "blocks").unionByName(lent).withColumn("epoch", F.expr("k div blocks"))
    return every.select("shard", "slot", "rank", "epoch", permuted("k % blocks", "blocks", f"rank * 104729 + epoch * 1299709 + {seed}").alias("block"))


def _pieces(at: DataFrame, sources: DataFrame) -> DataFrame:
    """(rank, block, doc_id, start, word_from, word_to, _k1, _k2): what each block holds of which row."""
    ranks = sources.select(F.col("source").alias("_s"), "rank")
    at = at.join(ranks, at.source.eqNullSafe(ranks._s)).drop("_s")
    pieces = at.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {BLOCK}, (start + size - 1) div {BLOCK})")))
    return pieces.select(
        "rank", "block", "doc_id", "start",
        F.greatest(F.col("block") * BLOCK - F.col("start"), F.lit(0)).alias("word_from"),
        F.least((F.col("block") + 1) * BLOCK - F.col("start"), F.col("size")).alias("word_to"), "_k1", "_k2",
    )


def mix(docs: DataFrame, seed: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(spans, documents, sources) of the mix.

    spans: shard, slot, epoch, rank, block, and the piece of a row in that block: doc_id, start (of the row in its source's
    stream), word_from, word_to (in the row, the end excluded), _k1, _k2.  documents: see placed().  sources: see targets().
    """
    at = placed(docs)
    sources = written(targets(at.groupBy("source").agg(F.sum("size").alias("source_size"))))
    return slots(sources, seed).hint("merge").join(_pieces(at, sources).hint("merge"), ["rank", "block"]), at, sources


def taken(docs: DataFrame, seed: int = 1) -> DataFrame:
    """doc_id, size, source_size, target, taken and first_shard (the first with words of the row) for each row of docs."""
    spans, at, sources = mix(docs, seed)
    words = spans.groupBy(F.col("rank").alias("_r"), F.col("start").alias("_b")).agg(F.sum(F.col("word_to") - F.col("word_from")).alias("_taken"), F.min("shard").alias("first_shard"))
    s = sources.select(F.col("source").alias("_s"), F.col("rank").alias("_rank"), "source_size", "target")
    at = at.join(s, F.col("source").eqNullSafe(F.col("_s")))
    at = at.join(words, (F.col("size") > 0) & (F.col("_rank") == F.col("_r")) & (F.col("start") == F.col("_b")), "left")
    return at.select("doc_id", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"), "first_shard")


def _joined(docs: DataFrame, plans: DataFrame, at: DataFrame) -> DataFrame:
    """docs with _plan, one each of their key's plans (_k1, _k2, plans); rows for which there is none go."""
    d = keyed(docs).join(plans, ["_k1", "_k2"])
    number = F.lit(1)
    if at.groupBy("_k1", "_k2").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        number = F.row_number().over(Window.partitionBy("_k1", "_k2").orderBy("n_chars", "lang"))
    return d.withColumn("_n", number).withColumn("_plan", F.get("plans", F.col("_n") - 1)).where("_plan is not null").drop("plans", "_k1", "_k2", "_n")


def _words() -> Column:
    """The words of a text, each with the white space before it."""
    return F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))


def shards(docs: DataFrame, seed: int = 1) -> DataFrame:
    """(shard, slot, source, epoch, block, text): the words of each slot, with one space between two.

    Ordered by shard and slot inside partitions by shard, as they are written out.
    """
    at = placed(docs)
    sources = written(targets(at.groupBy("source").agg(F.sum("size").alias("source_size"))))
    p = _pieces(at, sources)
    plans = p.groupBy("_k1", "_k2", "rank", "start").agg(F.collect_list(F.struct("block", "word_from", "word_to")).alias("pieces"))
    plans = plans.groupBy("_k1", "_k2").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "pieces"))).alias("plans"))
    d = _joined(columns_of(docs, *DOC_COLUMNS), plans, at).select(F.col("_plan.rank").alias("rank"), F.col("_plan.start").alias("start"), F.transform(_words(), lambda w: F.ltrim(F.translate(w, "\t\n\x0b\x0c\r", "     "))).alias("words"), F.explode("_plan.pieces").alias("p"))
    d = d.select("rank", "start", "p.block", F.array_join(F.slice("words", (F.col("p.word_from") + 1).cast("int"), (F.col("p.word_to") - F.col("p.word_from")).cast("int")), " ").alias("text"))
    blocks = d.groupBy("rank", "block").agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("t")).select("rank", "block", F.array_join("t.text", " ").alias("text"))
    out = slots(sources, seed).hint("merge").join(blocks.hint("merge"), ["rank", "block"]).join(sources.select("rank", "source"), "rank")
    return out.repartition("shard").sortWithinPartitions("shard", "slot").select("shard", "slot", "source", "epoch", "block", "text")


def mixed_documents(docs: DataFrame, seed: int = 1) -> DataFrame:
    """The mix as documents: copy j of a row holds the pieces that the mix takes at least j times, in order.

    A copy with all pieces is the text itself; else the words of its pieces with the white space before each.
    Rows that the mix takes no word of are not in it.
    """
    spans, at, _ = mix(docs, seed)
    times = spans.groupBy("rank", "start", "_k1", "_k2", "word_from", "word_to").agg(F.count("*").alias("times"))
    plan = times.groupBy("rank", "start", "_k1", "_k2").agg(F.array_sort(F.collect_list(F.struct("word_from", "word_to", "times"))).alias("pieces"), F.max("times").alias("most"))
    plans = plan.groupBy("_k1", "_k2").agg(F.array_sort(F.collect_list(F.struct("rank", "start", "pieces", "most"))).alias("plans"))
    d = _joined(columns_of(docs, *DOC_COLUMNS), plans, at)
    d = d.withColumns({"_copy": F.explode(F.sequence(F.lit(1), F.col("_plan.most").cast("int"))), "pieces": F.col("_plan.pieces")})
    d = d.withColumns({"pieces": F.filter("pieces", lambda p: p["times"] >= F.col("_copy")), "_words": _words()})
    some = F.ltrim(F.concat_ws("", F.flatten(F.transform("pieces", lambda p: F.slice("_words", (p["word_from"] + 1).cast("int"), (p["word_to"] - p["word_from"]).cast("int"))))))
    d = d.withColumn("text", F.when(F.expr("aggregate(pieces, 0L, (n, p) -> n + p.word_to - p.word_from)") == F.size("_words"), F.col("text")).otherwise(some))
    return d.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def _sql_hash(z: str) -> str:
    return f"(((({z}) % 2147483647) * (({z}) % 2147483647) % 2147483647 * 48271 + ({z}) % 2147483647) % 2147483647)"


def _sql_rounds(seed: int) -> str:
    """CTEs p1, p2, ...: the rounds that take x, in 0..n-1, to its block."""
    out, last = [], "p0"
    for r in range(1, ROUNDS + 1):
        out.append(f"h{r} AS (SELECT *, {_sql_hash(f'(rank * 104729 + epoch * 1299709 + {seed}) % 2147483647 + {7919 * r}')} AS h FROM {last})")
        out.append(f"y{r} AS (SELECT *, (h % blocks + blocks - x) % blocks AS y FROM h{r})")
        bit = _sql_hash("greatest(x, y) + h")
        out.append(f"p{r} AS MATERIALIZED (SELECT rank, blocks, epoch, shard, CASE WHEN {bit} // 1024 % 2 = 1 THEN y ELSE x END AS x FROM y{r})")
        last = f"p{r}"
    return ", ".join(out)


SQL = rf"""
WITH d AS MATERIALIZED (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    coalesce((((doc_id % 2147483647) + 2147483647) % 2147483647 * 48271 % 2147483647) % {BUCKETS}, 0) AS b
  FROM documents
), s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, [{', '.join(f'{float(x)}' for x in WEIGHTS)}][rank % {len(WEIGHTS)} + 1]::DOUBLE AS w, (source_size * {float(MOST)})::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) / sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM w),
t AS (SELECT *, coalesce(least(cap, max(CASE WHEN cap / w > lvl THEN lvl END) OVER () * w), 0.0)::DOUBLE AS target, ceil(source_size / {BLOCK}.0)::BIGINT AS blocks FROM l),
k AS (SELECT *, (CASE WHEN source_size > 0 THEN least(floor({MOST} * blocks), floor(target * blocks / source_size + 0.5)) ELSE 0 END)::BIGINT AS tickets FROM t),
f AS MATERIALIZED (SELECT *, (coalesce(sum(tickets) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS first_ticket, (sum(tickets) OVER ())::BIGINT AS all_tickets FROM k),
z AS (SELECT id, {_sql_hash(_sql_hash(f'(id % {PRIME} + id // {PRIME} * 7919 + 104723)'))} AS h FROM (SELECT unnest(generate_series(0, (SELECT max(all_tickets) - 1 FROM f))) AS id)),
x AS (SELECT id, least(floor((h + {_sql_hash('h + 12345')} / {PRIME}::DOUBLE) / {PRIME}::DOUBLE * (SELECT max(all_tickets) FROM f)::DOUBLE)::BIGINT, (SELECT max(all_tickets) - 1 FROM f)) AS at_ FROM z),
m AS MATERIALIZED (SELECT id, rank, tickets, row_number() OVER (PARTITION BY rank ORDER BY id) - 1 AS j, count(*) OVER (PARTITION BY rank) AS had FROM x JOIN f ON at_ >= first_ticket AND at_ < first_ticket + tickets),
j AS MATERIALIZED (SELECT id, rank, j - j * greatest(had - tickets, 0) // had AS k, (j + 1) * greatest(had - tickets, 0) // had > j * greatest(had - tickets, 0) // had AS free FROM m),
o AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i FROM j WHERE free),
q AS (SELECT f.rank, f.tickets, count(m.id) AS had FROM f LEFT JOIN m ON f.rank = m.rank WHERE f.tickets > 0 GROUP BY f.rank, f.tickets),
u AS (SELECT rank, had, tickets, unnest(generate_series(0, tickets - had - 1)) AS i FROM q WHERE had < tickets),
v AS (SELECT rank, had + i AS k, row_number() OVER (ORDER BY (2 * i + 1)::DOUBLE / (2 * (tickets - had))::DOUBLE, rank) - 1 AS i FROM u),
e AS MATERIALIZED (SELECT id, rank, k FROM j WHERE NOT free UNION ALL SELECT o.id, v.rank, v.k FROM o JOIN v ON o.i = v.i),
p0 AS MATERIALIZED (SELECT e.rank, f.blocks, e.k // f.blocks AS epoch, e.k % f.blocks AS x, e.id // {SHARD} AS shard FROM e JOIN f ON e.rank = f.rank),
{_sql_rounds(1)},
n AS (SELECT rank, x AS block, count(*) AS times, min(shard) AS shard FROM p{ROUNDS} GROUP BY rank, x),
a AS (SELECT d.doc_id, d.size, k.rank, k.source_size, k.target, row_number() OVER () AS row,
  coalesce(sum(d.size) OVER (PARTITION BY k.rank ORDER BY d.b, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source),
c AS (SELECT row, rank, start, size, unnest(generate_series(start // {BLOCK}, (start + size - 1) // {BLOCK})) AS block FROM a WHERE size > 0),
g AS (SELECT c.row, sum(n.times * (least((c.block + 1) * {BLOCK}, c.start + c.size) - greatest(c.block * {BLOCK}, c.start)))::BIGINT AS taken, min(n.shard)::BIGINT AS first_shard FROM c JOIN n ON c.rank = n.rank AND c.block = n.block GROUP BY c.row)
SELECT a.doc_id, a.size, a.source_size, a.target, coalesce(g.taken, 0)::BIGINT AS taken, g.first_shard FROM a LEFT JOIN g ON a.row = g.row
"""
