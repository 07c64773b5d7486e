r"""Chat formatting in budgeted windows, in SQL functions only, and reading it back.

Prefix sums of the turns' tokens (words plus a turn's marks) choose turn-aligned spans.  What a window may hold is BUDGET
less the conversation's system turn; part of that is for repeated history, the rest, the room, for the span.  Turns of at
most half the room go by where they begin: all that begin in the same half of a room are a span, which is no longer than
the room; a longer turn is a span of its own.  So no turn waits for another's choice.  Each span becomes a window: the
conversation's system turn (the first there is) unless it is in the span, at most HISTORY turns before the span within
their own budget, then the span.  A window exceeds BUDGET only where a single turn, with the system turn, does; then it
repeats no history.  What is repeated in a window carries no loss: under the loss mask lies each assistant text once.

Template: ``<|im_start|>role\ntext<|im_end|>\n`` for each turn.  In roles and texts ``&`` becomes ``&amp;`` and ``<|``
becomes ``&lt;|`` (in roles a line feed becomes ``&#10;``), so no mark can come from a text and all is undone exactly.

Defined results: a null text or role is empty; a null turn comes first, equal turns go by role, then text, and repeated
rows are turns each; a null conv_id is a conversation; turns of any length are kept whole; an empty table gives no
windows; other columns take no part.  A conversation's turns are ordered together, and read_back() gives a row for each
conversation with all of its text, since digests of whole conversations ask for that; so a conversation has to fit a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, columns_of

START, END = "<|im_start|>", "<|im_end|>\n"
#: Tokens of a window, most tokens of its repeated history, most turns of history, tokens that a turn's marks count.
BUDGET, HISTORY_BUDGET, HISTORY, MARKS = 1024, 256, 2, 4


def escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&#10;"), F.lit("\n")), F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def windows(turns: DataFrame) -> DataFrame:
    """conv_id, window, text, repeated (turns that the window repeats, at its beginning), turns, mask (start, length)."""
    t = columns_of(turns, "conv_id", "turn", "role", "text").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    head = F.concat(F.lit(START), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("&#10;")), F.lit("\n"))
    t = t.withColumns({"tokens": F.regexp_count("text", F.lit(WORD)) + MARKS, "head": head, "body": escaped(F.col("text"))})
    t = t.withColumn("piece", F.concat("head", "body", F.lit(END)))
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumns({
        "seq": F.row_number().over(w),
        "begin": F.coalesce(F.sum("tokens").over(before), F.lit(0)),
        "at": F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)),
        **{f"back{i}": F.lag(F.struct("piece", "tokens"), i).over(w) for i in range(1, HISTORY + 1)},
    })
    t = t.withColumn("system", F.first(F.when(F.col("role") == "system", F.struct("piece", "tokens", "seq", "begin")), ignorenulls=True).over(every))
    left = F.greatest(BUDGET - F.coalesce("system.tokens", F.lit(0)), F.lit(2))
    t = t.withColumn("left", left).withColumn("aside", F.expr(f"least({HISTORY_BUDGET}, left div 4)")).withColumn("half", F.expr("greatest((left - aside) div 2, 1)"))
    window = "2 * ({0}begin div half) + if({0}tokens > half, 1, 0)"
    t = t.withColumns({"window": F.expr(window.format("")), "home": F.expr(window.format("system.")), "may": F.expr("if(tokens > half, least(aside, greatest(left - tokens, 0)), aside)")})
    prefixed = F.col("system").isNotNull() & (F.col("home") != F.col("window"))
    context, used, repeated = F.lit(""), F.lit(0), prefixed.cast("int")
    for i in range(1, HISTORY + 1):
        used = used + F.col(f"back{i}.tokens")
        # the i-th turn before is there, is not the system turn, and all up to it fit
        fits = F.coalesce((used <= F.col("may")) & (F.col("system").isNull() | (F.col("seq") - i != F.col("system.seq"))), F.lit(False))
        context, repeated = F.concat(F.when(fits, F.col(f"back{i}.piece")).otherwise(""), context), repeated + fits.cast("int")
    context = F.concat(F.when(prefixed, F.col("system.piece")).otherwise(""), context)
    loss = F.when(F.col("role") == "assistant", F.struct((F.col("at") + F.length("head")).alias("start"), F.length("body").alias("length")))
    t = t.select("conv_id", "window", "seq", "at", "piece", loss.alias("loss"), F.struct("seq", "at", context.alias("context"), repeated.alias("repeated")).alias("opening"))
    g = t.groupBy("conv_id", "window").agg(F.min("opening").alias("o"), F.array_sort(F.collect_list(F.struct("seq", "piece", "loss"))).alias("t"))
    shift = F.length("o.context") - F.col("o.at")
    return g.select(
        "conv_id", "window", F.concat("o.context", F.array_join(F.col("t.piece"), "")).alias("text"), F.col("o.repeated").alias("repeated"), F.size("t").alias("turns"),
        F.transform(F.filter("t", lambda x: x["loss"].isNotNull()), lambda x: F.struct((x["loss"]["start"] + shift).alias("start"), x["loss"]["length"].alias("length"))).alias("mask"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns (role, line feed, text, line feed each), loss (all text under the mask), formatted_chars."""
    parts = F.split("text", r"<\|im_end\|>\n")
    new = F.slice(parts, F.col("repeated") + 1, F.greatest(F.size(parts) - 1 - F.col("repeated"), F.lit(0)))
    turns = F.transform(new, lambda p: F.concat(unescaped(F.substring(p, len(START) + 1, 1 << 30)), F.lit("\n")))
    loss = F.transform("mask", lambda m: unescaped(F.substring(F.col("text"), (m["start"] + 1).cast("int"), m["length"].cast("int"))))
    w = formatted.select("conv_id", F.struct("window", F.array_join(turns, "").alias("turns"), F.array_join(loss, "").alias("loss")).alias("w"), F.size(new).alias("n"), F.length("text").alias("chars"))
    g = w.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    return g.select("conv_id", "n_turns", F.array_join("w.turns", "").alias("turns"), F.array_join("w.loss", "").alias("loss"), "formatted_chars")


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the windows."""
    return read_back(windows(turns)).select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), p AS (
  SELECT *, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + {MARKS} AS tokens,
    length('{START}') + length(replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&#10;')) + 1
    + length(replace(replace(text, '&', '&amp;'), '<|', '&lt;|')) + length('{END.strip()}') + 1 AS chars
  FROM t
), q AS (
  SELECT *, row_number() OVER w AS seq, sum(tokens) OVER w - tokens AS from_,
    lag(chars, 1) OVER w AS c1, lag(tokens, 1) OVER w AS t1, lag(chars, 2) OVER w AS c2, lag(tokens, 2) OVER w AS t2
  FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), y AS (
  SELECT conv_id, min_by(chars, seq) AS sc, min_by(tokens, seq) AS st, min(seq) AS ss, min_by(from_, seq) AS sf FROM q WHERE role = 'system' GROUP BY conv_id
), b AS (SELECT q.*, y.sc, y.st, y.ss, y.sf, greatest({BUDGET} - coalesce(y.st, 0), 2) AS left_ FROM q LEFT JOIN y ON q.conv_id IS NOT DISTINCT FROM y.conv_id
), h AS (SELECT *, least({HISTORY_BUDGET}, left_ // 4) AS aside, greatest((left_ - least({HISTORY_BUDGET}, left_ // 4)) // 2, 1) AS half FROM b
), k AS (
  SELECT *, 2 * (from_ // half) + (CASE WHEN tokens > half THEN 1 ELSE 0 END) AS win, 2 * (sf // half) + (CASE WHEN st > half THEN 1 ELSE 0 END) AS home,
    CASE WHEN tokens > half THEN least(aside, greatest(left_ - tokens, 0)) ELSE aside END AS may
  FROM h
), r AS (
  SELECT *, CASE WHEN ss IS NOT NULL AND home <> win THEN sc ELSE 0 END
    + CASE WHEN t1 <= may AND (ss IS NULL OR seq - 1 <> ss) THEN c1 ELSE 0 END
    + CASE WHEN t1 + t2 <= may AND (ss IS NULL OR seq - 2 <> ss) THEN c2 ELSE 0 END AS context
  FROM k
), o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, win ORDER BY seq) AS nth FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY seq)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY seq), '')) AS loss_sha256,
  sum(chars + CASE WHEN nth = 1 THEN context ELSE 0 END)::BIGINT AS formatted_chars
FROM o GROUP BY conv_id
"""
