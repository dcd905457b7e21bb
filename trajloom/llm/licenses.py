"""License scans: exact phrases and an exact set-similarity join with license templates.

Notices are often wrapped, so a template's text blocks are runs of lines: each line, with the lines after it until these
hold as many words as the template's text. Lines without words count for nothing. Any stretch of so many words
lies in a block, whatever the wrapping. A template is found in a block when the block holds at least ``threshold`` of the
template's distinct words. The join is exact, with three filters over words in one global order, rarest first (document
frequency over *all* documents). They go over whole documents first, which hold all of their blocks:

* prefix: of a template with n words, of which k are needed, one of its n-k+1 rarest must be there;
* length: there must be k words of the template vocabulary;
* position: what follows the first common word on both sides must still suffice for k.

The blocks of the documents and templates that are left are then compared, from lines with a word of the template alone.

Templates are a parameter of bounded size (at most ``MAX_TEMPLATE_WORDS`` words in all, checked), so
their index is broadcast; documents never are. What blocks give meets the documents by the MD5 of the
text, so repeated rows need no row number.
DataFrame functions only.

Defined cases: null or empty text has no words, no places, null first and last word, empty labels and
score 0; score is 1 where a phrase stands, else the largest containment reached, else 0; repeated rows
give repeated results; other columns are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajloom.llm.common import lower_ascii, whole_text

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Lines that license notices are made of.
TEMPLATES = [
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright under cc0 1 0 universal"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

MAX_TEMPLATE_WORDS = 100_000
SALTS = 32
_NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"  # of lower-cased text
_NOT_WORD_ANY_CASE = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def _pieces(text: Column, pattern: str) -> Column:
    """split() with an empty string before a leading and after a trailing separator."""
    return F.split(text, pattern)


def _without_empty_ends(pieces: Column) -> Column:
    n, first, last = F.size(pieces), F.element_at(pieces, 1), F.element_at(pieces, -1)
    start = F.when(first == "", 2).otherwise(1)
    return F.slice(pieces, start, F.greatest(F.lit(0), n - start + 1 - F.when((last == "") & (n > 1), 1).otherwise(0)))


def _scanned(docs: DataFrame, watched: list[str]) -> DataFrame:
    """n_words of all texts; words (lower case) of those with a watched word, else null."""
    df = docs.withColumn("raw", _pieces(F.col("text"), _NOT_WORD_ANY_CASE))
    empty = F.lit("")
    df = df.withColumn("n_words", F.size("raw") - F.when(F.element_at("raw", 1) == empty, 1).otherwise(0) - F.when((F.size("raw") > 1) & (F.element_at("raw", -1) == empty), 1).otherwise(0))
    near = F.exists("raw", lambda w: F.lower(w).isin(*watched))  # lower() of other letters only lets more through
    return df.withColumn("near", near).drop("raw")


def _places(words: Column) -> Column:
    """Structs (i, label) of each phrase's places, in order of i."""
    longest = max(len(p.split()) for p in PHRASES)
    n = F.greatest(F.size(words), F.lit(1))
    side = F.arrays_zip(*[F.slice(words, k + 1, n).alias(f"w{k}") for k in range(longest)])

    def label(s):
        out = F.lit(None).cast("string")
        for phrase, name in PHRASES.items():
            hit = F.lit(True)
            for k, w in enumerate(phrase.split()):
                hit = hit & F.coalesce(s[f"w{k}"] == w, F.lit(False))
            out = F.when(hit, F.lit(name)).otherwise(out)
        return out

    return F.filter(F.transform(side, lambda s, i: F.struct(i.alias("i"), label(s).alias("label"))), lambda x: x["label"].isNotNull())


def _document_frequency(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many documents each template word stands; as many rows as the vocabulary has."""
    words = F.array_distinct(F.transform(F.filter(F.split("text", _NOT_WORD_ANY_CASE), lambda w: F.lower(w).isin(*vocabulary)), lambda w: F.lower(w)))
    rows = docs.select(F.explode(words).alias("w")).groupBy("w").count().collect()
    return {r["w"]: r["count"] for r in rows}


def template_index(docs: DataFrame, templates=None, threshold: float = 0.9) -> tuple[dict[str, int], list[tuple]]:
    """The words' ranks, rarest first, and of each template (id, label, words' ranks in order, needed, words of its text)."""
    sets = [(label, sorted(set(text.split())), len(text.split())) for label, text in (TEMPLATES if templates is None else templates)]
    if sum(len(ws) for _, ws, _ in sets) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates have more than {MAX_TEMPLATE_WORDS} words")
    vocabulary = sorted({w for _, ws, _ in sets for w in ws})
    if not vocabulary:
        return {}, []
    seen = _document_frequency(docs, vocabulary)
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (seen.get(w, 0), w)))}
    return rank, [(k, label, sorted(rank[w] for w in ws), math.ceil(threshold * len(ws) - 1e-9), long) for k, (label, ws, long) in enumerate(sets) if ws]


def template_matches(docs: DataFrame, rank: dict[str, int], index: list[tuple]) -> DataFrame:
    """(key, label, containment) for each document and template at the threshold in some block; docs: key, text."""
    spark = docs.sparkSession
    entries = [(ranks[i], k, i, len(ranks), need, long, label, ranks) for k, label, ranks, need, long in index for i in range(len(ranks) - need + 1)]
    prefix = spark.createDataFrame(entries, "rank int, template int, at int, n int, need int, long int, label string, ranks array<int>")
    rare, least = sorted({e[0] for e in entries}), min((e[4] for e in entries), default=1)
    ranks = F.create_map(*[F.lit(x) for w, r in rank.items() for x in (w, r)])
    words = F.array_distinct(F.filter(F.split(lower_ascii(F.col("text")), _NOT_WORD), lambda w: w.isin(*rank)))
    whole = docs.select("key", "text", words.alias("known")).filter(F.size("known") >= least)  # length filter for any template
    whole = whole.select("key", "text", F.sort_array(F.transform("known", lambda w: ranks[w])).alias("own"))
    hits = whole.select("key", "text", "own", F.explode(F.filter(F.transform("own", lambda r, j: F.struct(r.alias("rank"), j.alias("j"))), lambda x: x["rank"].isin(*rare))).alias("x"))
    pairs = hits.select("key", "text", "own", "x.rank", "x.j").join(F.broadcast(prefix), "rank")
    room = F.least(F.col("n") - F.col("at"), F.size("own") - F.col("j"))
    pairs = pairs.filter((F.size("own") >= F.col("need")) & (room >= F.col("need")))
    # The first common word alone reports the pair; later ones of the same prefix are repeats.
    both = F.array_intersect("own", "ranks")
    pairs = pairs.withColumn("both", both).filter((F.element_at("both", 1) == F.col("rank")) & (F.size("both") >= F.col("need")))
    # Lines with words: how many, and which of the template's.
    split = F.transform(F.split(lower_ascii(F.col("text")), "\n"), lambda x: F.filter(F.split(x, _NOT_WORD), lambda w: w != ""))
    lines = F.transform(F.filter(split, lambda ws: F.size(ws) > 0), lambda ws: F.struct(F.size(ws).alias("n"), F.array_intersect(F.transform(F.filter(ws, lambda w: w.isin(*rank)), lambda w: ranks[w]), F.col("ranks")).alias("own")))
    pairs = pairs.select("key", "label", "n", "need", "long", lines.alias("lines"))
    # All lines but the first hold a word, so a block has at most ``long`` more of them.
    blocks = pairs.select("key", "label", "n", "need", "long", "lines", F.posexplode("lines").alias("at", "line")).filter(F.size("line.own") > 0)
    start = F.struct(F.lit(0).alias("n"), F.col("line.own").alias("own"))
    more = lambda acc, x: F.when(acc["n"] >= F.col("long"), acc).otherwise(F.struct((acc["n"] + x["n"]).alias("n"), F.array_union(acc["own"], x["own"]).alias("own")))
    block = F.aggregate(F.slice("lines", F.col("at") + 2, F.col("long")), start, more)
    found = blocks.select("key", "label", "n", "need", F.size(block["own"]).alias("held")).filter(F.col("held") >= F.col("need"))
    return found.select("key", "label", (F.col("held") / F.col("n")).alias("containment"))


def license_report(docs: DataFrame, templates=None, threshold: float = 0.9) -> DataFrame:
    """One row for each document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    docs = whole_text(docs, "doc_id")
    rank, index = template_index(docs, templates, threshold)
    prefix_words = [w for w, r in rank.items() if any(r in ranks[: len(ranks) - need + 1] for _, _, ranks, need, _ in index)]
    phrase_words = sorted({p.split()[0] for p in PHRASES})
    may = F.exists(F.split("text", _NOT_WORD_ANY_CASE), lambda w: F.lower(w).isin(*prefix_words)) if index else F.lit(False)
    # Texts that no template can be in get a key of their own and a salt deals the copies of the others, so that equal texts don't meet.
    alone = F.md5(F.concat(F.lit("~"), F.coalesce(F.col("doc_id").cast("string"), F.uuid())))
    base = _scanned(docs, phrase_words).withColumns({"key": F.when(may, F.md5(F.col("text"))).otherwise(alone), "salt": F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")})
    base = base.withColumn("words", F.when(F.col("near"), _without_empty_ends(_pieces(lower_ascii(F.col("text")), _NOT_WORD))))
    base = base.withColumn("places", F.when(F.col("near"), _places(F.col("words"))))
    base = base.withColumn("base_list", F.coalesce(F.array_distinct(F.col("places.label")), F.array().cast("array<string>")))
    base = base.select("doc_id", "key", "salt", F.col("n_words").cast("bigint"), F.coalesce(F.size("places"), F.lit(0)).alias("n_base"), F.array_min("places.i").cast("bigint").alias("first_word"), F.array_max("places.i").cast("bigint").alias("last_word"), "base_list")
    base = base.withColumn("n_base", F.greatest(F.col("n_base"), F.lit(0)).cast("bigint"))
    if index:
        some = docs.filter(may).select(F.md5("text").alias("key"), "text")
        found = template_matches(some, rank, index).groupBy("key").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
        base = base.join(found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["key", "salt"], "left")
    else:
        base = base.withColumns({"more": F.lit(None).cast("array<string>"), "best": F.lit(None).cast("double")})
    every = F.array_sort(F.array_union("base_list", F.coalesce("more", F.array().cast("array<string>"))))
    return base.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base_list"), ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))
