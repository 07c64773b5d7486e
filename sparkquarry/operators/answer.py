"""Contexts, answers and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_HITS = "No relevant information was found for this question."
FAILED = "The answer could not be made."
_CITED = r"\^\[(Context_\d+)\]"


def contexts(ranked: DataFrame, order: str = "rerank_position", text: str = "text") -> DataFrame:
    """qid, contexts (array of no, text, id, in order) and context_text, the tagged contexts set apart by blank lines."""
    g = ranked.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(F.col(order).cast("int").alias("no"), F.coalesce(text, F.lit("")).alias("text"), F.col("id").cast("string").alias("id")))).alias("contexts"))
    g = g.withColumn("contexts", F.transform("contexts", lambda c, i: F.struct((i + 1).alias("no"), c["text"].alias("text"), c["id"].alias("id"))))
    tag = lambda c: F.concat(F.lit("Context_"), c["no"].cast("string"))
    return g.withColumn("context_text", F.array_join(F.transform("contexts", lambda c: F.concat(F.lit("<"), tag(c), F.lit(">\n"), c["text"], F.lit("\n</"), tag(c), F.lit(">"))), "\n\n"))


def prompt(query: Column, context_text: Column) -> Column:
    return F.concat(
        F.lit("Answer the question only from the numbered contexts, in bullet points, each followed by its sources as ^[Context_N]; if they hold no answer, reply na.\n\n"),
        context_text, F.lit("\n\nQuestion: "), query,
    )


def extractive(df: DataFrame, k: int = 3) -> DataFrame:
    """The default generator: the first sentence of each of the first k contexts, cited; na without contexts."""
    sentence = lambda t: F.regexp_extract(t, r"(?s)^\s*(.*?[.!?](?=\s|$)|.+$)", 1)
    lines = F.transform(F.slice("contexts", 1, k), lambda c: F.concat(F.lit("- "), sentence(c["text"]), F.lit(" ^[Context_"), c["no"].cast("string"), F.lit("]")))
    return df.withColumn("raw_answer", F.when(F.coalesce(F.size("contexts"), F.lit(0)) > 0, F.array_join(lines, "\n")).otherwise("na"))


def cited(answers: DataFrame) -> DataFrame:
    """Add answer, its citations numbered in order of appearance (a repeated one gets a new number), and cited.

    cited: array of (id, references_original_context, source (no, text, id), error); the error names a context that is not
    there. A missing raw answer gives the failure message.
    """
    raw = F.col("raw_answer")
    found = F.regexp_extract_all(raw, F.lit(_CITED), F.lit(1))
    between = F.split(raw, r"\^\[Context_\d+\]", -1)
    text = F.array_join(F.transform(between, lambda s, i: F.when(i < F.size(between) - 1, F.concat(s, F.lit("^["), (i + 1).cast("string"), F.lit("]"))).otherwise(s)), "")

    def source(name, i):
        hit = F.get(F.filter("contexts", lambda c: c["no"] == F.regexp_extract(name, r"(\d+)$", 1).cast("int")), F.lit(0))
        return F.struct((i + 1).alias("id"), name.alias("references_original_context"), hit.alias("source"), F.when(hit.isNull(), F.concat(F.lit("Original context "), name, F.lit(" not found"))).alias("error"))

    a = answers.withColumn("cited", F.transform(F.coalesce(found, F.array().cast("array<string>")), source))
    plain_na = (F.lower(F.regexp_replace(raw, r"^\s+|\s+$", "")) == "na") & (F.size("cited") == 0)
    return a.withColumn("answer", F.when(raw.isNull(), FAILED).when(plain_na, "na").otherwise(text))


def answered(queries: DataFrame, ranked: DataFrame, generator=extractive) -> DataFrame:
    """One row a question: answer and citations, or the fixed message where nothing was found."""
    q = queries.join(contexts(ranked), "qid", "left")
    a = cited(generator(q))
    none = F.coalesce(F.size("contexts"), F.lit(0)) <= 0
    return a.withColumn("answer", F.when(none, NO_HITS).otherwise(F.col("answer")))
