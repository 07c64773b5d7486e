"""Entities with offsets: the default lexicon model and what is done to any model's entities.

Entities are an array of structs in a row beside their text; all steps are folds and transforms over it, so a text's
entities never leave their row.  A model is any function DataFrame -> DataFrame that adds the array (see lexicon()).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.text import among, held, let, lookup, whole_words
from ..functions.text import parts_of as parts_of_pattern

ENTITY = "struct<text:string,type:string,start:int,end:int,confidence:double,normalized:string,synonyms:array<string>,metadata:map<string,string>>"
THRESHOLD = 0.7
#: Characters of a text from which a model gets it in parts, most characters of a part, texts that a model gets at once.
LONG, PART, BATCH = 2048, 1536, 32


def tag_type(tag: Column) -> Column:
    """A model's tag as an entity type: the first part that the tag holds, else other; B- and I- marks don't matter."""
    low = F.lower(tag)
    return reduce(lambda out, kv: out.when(low.contains(kv[0]), kv[1]), vocab.TAG_TYPES.items(), F.when(F.lit(False), "")).otherwise("other")


def entity(text: Column, kind: Column, start: Column, end: Column, confidence: Column) -> Column:
    return F.struct(text.alias("text"), kind.alias("type"), start.cast("int").alias("start"), end.cast("int").alias("end"), confidence.cast("double").alias("confidence"), F.lit(None).cast("string").alias("normalized"), F.array().cast("array<string>").alias("synonyms"), F.map_from_arrays(F.array(), F.array()).cast("map<string,string>").alias("metadata"))


_LEXICON = {**vocab.CHUNK_ENTITIES, "dosage": [r"\b\d+(?:\.\d+)?\s*(?:mg|mcg|ml|g|units?)\b"], "frequency": [r"\b(?:twice\s+(?:a\s+)?day|three\s+times\s+(?:a\s+)?day|every\s+\d+\s+hours?|once\s+daily|twice\s+daily|daily)\b"]}

#: Words with which a frequency begins.
_BEGIN = {"frequency": ("twice", "three", "every", "once", "daily")}


def _placed(kind: str):
    """Fold step: the next match stands after what lies between."""

    def step(acc, x):
        begin = acc["at"] + F.length(x["b"])
        end = begin + F.length(x["h"])
        return F.struct(end.alias("at"), F.array_append(acc["e"], entity(x["h"], F.lit(kind), begin, end, F.lit(0.9))).alias("e"))

    return step


def _offsets(text: Column, pattern: str, kind: str):
    """A function of a pattern's matches in a text: the entities that they are. A text without any is not gone through again."""
    none = F.array().cast(f"array<{ENTITY}>")

    def placed(hits):
        # offsets: pieces between matches, summed up in one fold
        between = F.split(text, f"(?i){whole_words(pattern)}", -1)
        return F.when(F.size(hits) == 0, none).otherwise(F.aggregate(F.arrays_zip(F.slice(between, 1, F.size(hits)).alias("b"), hits.alias("h")), F.struct(F.lit(0).alias("at"), none.alias("e")), _placed(kind))["e"])

    return placed


def lexicon(df: DataFrame, text: str = "text", out: str = "entities") -> DataFrame:
    """The default model: pattern matches with offsets. A match's n-th occurrence is found by splitting before it."""
    tried = [(kind, p) for kind, patterns in _LEXICON.items() for p in patterns]
    found = lambda v: [let(among(v["c"], v["may"], i, p), _offsets(v["c"], p, kind)) for i, (kind, p) in enumerate(tried)]
    may = held(F.col(text), [_BEGIN.get(kind) or parts_of_pattern(p) for kind, p in tried])
    every = let(F.struct(F.col(text).alias("c"), may.alias("may")), lambda v: F.concat(*found(v)))
    every = F.array_sort(every, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    # where matches overlap the one that begins first, and of those the longest, stays
    kept = F.aggregate(every, F.array().cast(f"array<{ENTITY}>"), lambda acc, e: F.when((F.size(acc) > 0) & (F.coalesce(F.element_at(acc, -1)["end"], F.lit(0)) > e["start"]), acc).otherwise(F.array_append(acc, e)))
    return df.withColumn(out, kept)


def parts_of(text: str) -> list[tuple[int, str]]:
    """(offset, part) of a text: whole if it is short, else sentences packed up to PART characters; a longer one stays whole.

    Offsets are those in the text itself, whatever white space stands between sentences.
    """
    if len(text) <= LONG:
        return [(0, text)]
    out, begin, end = [], 0, 0
    while end < len(text):
        at = text.find(". ", end)
        stop = len(text) if at < 0 else at + 2
        if end > begin and stop - begin > PART:
            out.append((begin, text[begin:end]))
            begin = end
        end = stop
    return [*out, (begin, text[begin:end])]


def batched(load: Callable[[], Callable[[list[str]], list[list[dict]]]]) -> Callable[[DataFrame, str, str], DataFrame]:
    """A model for enriched() and processed() from ``load``, which is called once in each Python worker.

    It returns a function of a list of texts that gives a list of entities for each: dicts of word, entity_group (a tag,
    see tag_type), start, end, score.  Texts come in Arrow batches and go to it BATCH at a time, long ones in parts, whose
    offsets are put right.  A null text has no entities.
    """

    @F.pandas_udf("array<struct<word:string,tag:string,start:int,end:int,score:double>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            parts = [(i, offset, part) for i, t in enumerate(texts) if t for offset, part in parts_of(t)]
            found = [[] for _ in range(len(texts))]
            for k in range(0, len(parts), BATCH):
                some = parts[k : k + BATCH]
                for (i, offset, _), entities in zip(some, model([p for _, _, p in some]), strict=True):
                    found[i] += [{"word": e["word"], "tag": e["entity_group"], "start": e["start"] + offset, "end": e["end"] + offset, "score": float(e["score"])} for e in entities]
            yield pd.Series(found, index=texts.index)

    def add(df: DataFrame, text: str = "text", out: str = "entities") -> DataFrame:
        return df.withColumn(out, run(F.col(text))).withColumn(out, F.transform(out, lambda e: entity(e["word"], tag_type(e["tag"]), e["start"], e["end"], e["score"])))

    return add


def to_json(entities: Column) -> Column:
    """Entities as a JSON array, fields without a value left out."""
    return F.to_json(entities)


def from_json(text: Column) -> Column:
    """Entities of a JSON array; what it lacks is null, synonyms and metadata are empty."""
    e = F.from_json(text, f"array<{ENTITY}>")
    return F.transform(e, lambda x: _with(x, synonyms=F.coalesce(x["synonyms"], F.array().cast("array<string>")), metadata=F.coalesce(x["metadata"], F.map_from_arrays(F.array(), F.array()).cast("map<string,string>"))))


def confident(entities: Column, threshold: float = THRESHOLD) -> Column:
    return F.filter(entities, lambda e: e["confidence"] >= threshold)


def by_place(entities: Column) -> Column:
    return F.array_sort(entities, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["end"] - b["end"]))


def merged(entities: Column, text: Column) -> Column:
    """Neighbours at most three characters apart, with nothing, a hyphen or a slash between, become one entity if both are
    amounts or both are drugs. Pairs are taken greedily from the left: what was merged does not merge again."""
    amount = lambda k: k.isin("dosage", "strength")
    start = F.struct(F.array().cast(f"array<{ENTITY}>").alias("out"), F.lit(True).alias("closed"))

    def step(acc, e):
        last = F.element_at(acc["out"], -1)
        gap = F.substring(text, last["end"] + 1, F.greatest(e["start"] - last["end"], F.lit(0)))
        near = (F.length(gap) <= 3) & F.trim(F.regexp_replace(gap, r"\s", " ")).isin("", "-", "/")
        kin = (amount(last["type"]) & amount(e["type"])) | ((last["type"] == "drug") & (e["type"] == "drug"))
        one = F.struct(
            F.substring(text, last["start"] + 1, e["end"] - last["start"]).alias("text"), F.when(last["type"] == e["type"], last["type"]).otherwise("dosage").alias("type"), last["start"].alias("start"), e["end"].alias("end"),
            F.least(last["confidence"], e["confidence"]).alias("confidence"), F.lit(None).cast("string").alias("normalized"), F.array().cast("array<string>").alias("synonyms"),
            F.create_map(F.lit("merged_from"), F.concat_ws("|", last["text"], e["text"]), F.lit("original_types"), F.concat_ws("|", last["type"], e["type"])).alias("metadata"),
        )
        join = ~acc["closed"] & F.coalesce(near & kin, F.lit(False))
        return F.struct(F.when(join, F.array_append(F.slice(acc["out"], 1, F.greatest(F.size(acc["out"]) - 1, F.lit(0))), one)).otherwise(F.array_append(acc["out"], e)).alias("out"), join.alias("closed"))

    return F.aggregate(entities, start, step)["out"]


def _with(e: Column, **fields: Column) -> Column:
    names = ("text", "type", "start", "end", "confidence", "normalized", "synonyms", "metadata")
    return F.struct(*[(fields.get(n) if n in fields else e[n]).alias(n) for n in names])


def abbreviations(entities: Column) -> Column:
    def one(e):
        full = lookup(F.lower(e["text"]), vocab.ENTITY_ABBREVIATIONS)
        found = full.isNotNull()
        return _with(e, normalized=F.coalesce(full, e["normalized"]), synonyms=F.when(found, F.array_append(e["synonyms"], e["text"])).otherwise(e["synonyms"]), metadata=F.when(found, F.map_concat(F.map_filter(e["metadata"], lambda k, _: k != "abbreviation_expanded"), F.create_map(F.lit("abbreviation_expanded"), F.lit("true")))).otherwise(e["metadata"]))

    return F.transform(entities, one)


def normalised(entities: Column) -> Column:
    """Amounts without inner spaces, frequencies in one wording."""

    def one(e):
        base = F.coalesce(e["normalized"], e["text"])
        out = e["normalized"]
        for kind, rules in vocab.NORMALISATIONS.items():
            text = reduce(lambda c, r: F.regexp_replace(c, f"(?i){r[0]}", r[1]), rules, base)
            out = F.when((e["type"] == kind) & (text != e["text"]), text).otherwise(out)
        return _with(e, normalized=out)

    return F.transform(entities, one)


def related(entities: Column) -> Column:
    """A drug and the first amount among the three entities after it, if under 50 characters away, name each other."""
    amount = lambda e: e["type"].isin("dosage", "strength") & F.lit(True)

    def all_of(ordered):
        def target(i):
            """Place of the amount that the drug at place i takes, or null."""
            drug = F.get(ordered, i)
            near = F.filter(F.sequence(i + 1, i + 3), lambda j: (j < F.size(ordered)) & F.coalesce(amount(F.get(ordered, j)), F.lit(False)) & (F.get(ordered, j)["start"] - drug["end"] < 50))
            return F.when(drug["type"] == "drug", F.get(near, F.lit(0)))

        def one(e, i):
            mine = F.get(ordered, target(i))["text"]
            back = F.filter(F.sequence(i - 3, i - 1), lambda j: (j >= 0) & (target(j) == i))
            drug = F.get(ordered, F.element_at(F.when(F.size(back) > 0, back), -1))["text"]
            add = F.map_filter(F.create_map(F.lit("related_dosage"), mine, F.lit("related_drug"), drug), lambda _, v: v.isNotNull())
            return _with(e, metadata=F.map_concat(F.map_filter(e["metadata"], lambda k, _: ~k.isin("related_dosage", "related_drug")), add))

        return F.transform(ordered, one)

    # the order is made once for all entities
    return let(by_place(entities), all_of)


def in_context(entities: Column, text: Column) -> Column:
    """Confidence a tenth higher, at most 1, near words that speak for the type."""

    def one(e):
        first = F.greatest(e["start"] - 50, F.lit(0))
        near = F.lower(F.substring(text, first + 1, e["end"] + 50 - first))
        hit = reduce(lambda a, b: a | b, [(e["type"] == kind) & near.rlike("|".join(ws)) for kind, ws in vocab.CONTEXT_WORDS.items()])
        return _with(e, confidence=F.when(hit, F.least(F.lit(1.0), e["confidence"] * 1.1)).otherwise(e["confidence"]))

    return F.transform(entities, one)


def processed(df: DataFrame, text: str = "text", entities: str = "entities", threshold: float = THRESHOLD) -> DataFrame:
    """All steps in order: confident ones by place, merged, abbreviations, normal forms, relations, context.

    Each step is a column of its own, so that no expression holds the one before it more than once.
    """
    steps = [lambda e, t: by_place(confident(e, threshold)), merged, lambda e, t: abbreviations(e), lambda e, t: normalised(e), lambda e, t: related(e), in_context]
    for step in steps:
        df = df.withColumn(entities, step(F.col(entities), F.col(text)))
    return df


def summary(entities: Column) -> Column:
    """Type -> distinct texts (ignoring case, the first spelling stays), by type."""
    kinds = F.array_sort(F.array_distinct(F.transform(entities, lambda e: e["type"])))

    def texts(kind):
        own = F.transform(F.filter(entities, lambda e: e["type"] == kind), lambda e: e["text"])
        return F.filter(own, lambda t, i: F.array_position(F.transform(own, lambda x: F.lower(x)), F.lower(t)) == i + 1)

    return F.map_from_arrays(kinds, F.transform(kinds, texts))


def unique(entities: Column) -> Column:
    """The first entity of each normal form, or lower-cased text."""
    keys = F.transform(entities, lambda e: F.coalesce(e["normalized"], F.lower(e["text"])))
    return F.filter(entities, lambda e, i: F.array_position(keys, F.coalesce(e["normalized"], F.lower(e["text"]))) == i + 1)


def answer_types(entities: Column, section_type: Column) -> Column:
    """Answer types that the entities' types and the section stand for, sorted; general if none."""
    has = lambda *kinds: F.exists(entities, lambda e: e["type"].isin(*kinds))
    found = F.array(F.when(has("drug", "disease"), "definition"), F.when(has("disease"), "diagnosis"), F.when(has("procedure"), "procedure"), F.when(has("dosage", "frequency"), "dosage"), lookup(section_type, vocab.SECTION_ANSWERS))
    found = F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull())))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("general")))


def enriched(chunks: DataFrame, model=lexicon, text: str = "chunk") -> DataFrame:
    """Chunks with a model's entities, their summary by type, stored entity lists and answer types."""
    c = processed(model(chunks, text, "ner_entities"), text, "ner_entities")
    c = c.withColumn("entity_summary", summary(F.col("ner_entities")))
    low = lambda kind: F.coalesce(F.transform(F.element_at("entity_summary", kind), lambda x: F.lower(x)), F.array().cast("array<string>"))
    return c.withColumns({"drugs": low("drug"), "diseases": low("disease"), "procedures": low("procedure"), "has_medical_entities": F.size("ner_entities") > 0, "answer_types": answer_types(F.col("ner_entities"), F.col("section_type"))})
