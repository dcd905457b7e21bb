"""Document fingerprints: a Merkle tree over leaves, paragraphs and sections of each text.

Paragraphs are the lines of a text; a paragraph's leaves are its sentences, cut at ``LEAF`` code points. Sections are
cut by content: one ends behind a paragraph whose digest ends in 0 or 8, so eight paragraphs on average, and a line put in
changes its own section alone. Every digest is SHA-256, of a leaf's text or of the children's whole digests in order, tagged by level; the
root is that of the sections. Equal texts have equal roots, others differ but for a collision of SHA-256. The fingerprint is
``root:leaves:paragraphs:sections``: the whole root, then the first 16 digits of the digests of each level in order, enough to walk
down differing branches.

Likeness of two fingerprints is 1 where the roots are equal, else 2|A and B| / (|A|+|B|) over their sets of
nodes, each root one node more: an edit changes only the nodes above it.

The edited text needs the next document in descending doc_id. Documents are sorted by range over all
tasks; inside a task the next row is a window over that task's key range, and only one row a
range, its first, meets the ranges' last rows.

Defined cases: null or empty text is one empty paragraph; a null doc_id comes last; equal doc_ids are
ordered by the hash of their texts; rows alike in both are one document in the order, and each gets its row;
a lone document is its own next; an empty table gives no rows; other columns are left out. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajloom.llm.common import whole_text, written

LEAF = 256
#: Sentences with the marks that end them; marks alone; nothing is left out.
_SENTENCE = f"(?s)[^.!?]{{1,{LEAF}}}[.!?]{{0,3}}|[.!?]{{1,{LEAF}}}"
_SHORT = 16


def _digest(level: str, text: Column) -> Column:
    return F.sha2(F.concat(F.lit(level), text).cast("binary"), 256)


def with_tree(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """Adds {prefix}fingerprint and {prefix}nodes (the distinct digests of all levels but the root, as 64-bit numbers)."""
    p = lambda n: f"{prefix}{n}"
    df = df.withColumn(p("paras"), F.split(F.col(text), "\n"))
    leaf = lambda x: F.transform(F.regexp_extract_all(x, F.lit(_SENTENCE), F.lit(0)), lambda y: _digest("leaf", y))
    df = df.withColumn(p("leaves"), F.transform(F.col(p("paras")), leaf))
    df = df.withColumn(p("digests"), F.transform(F.col(p("leaves")), lambda x: _digest("paragraph", F.array_join(x, ""))))
    # Places of the paragraphs that end a section; the last one ends the last.
    marked = F.transform(F.col(p("digests")), lambda x, i: F.when(F.substring(x, 64, 1).isin("0", "8"), i + 1))
    df = df.withColumn(p("ends"), F.array_distinct(F.concat(F.filter(marked, lambda x: x.isNotNull()), F.array(F.size(p("digests"))))))
    df = df.withColumn(p("starts"), F.concat(F.array(F.lit(1)), F.transform(F.slice(p("ends"), 1, F.size(p("ends")) - 1), lambda x: x + 1)))
    section = lambda a, b: _digest("section", F.array_join(F.slice(F.col(p("digests")), a, b - a + 1), ""))
    df = df.withColumn(p("sections"), F.zip_with(p("starts"), p("ends"), section))
    levels = [F.flatten(p("leaves")), F.col(p("digests")), F.col(p("sections"))]
    parts = [F.array_join(F.transform(x, lambda d: F.substring(d, 1, _SHORT)), "") for x in levels]
    return df.withColumns({
        p("fingerprint"): F.concat_ws(":", _digest("root", F.array_join(p("sections"), "")), *parts),
        p("nodes"): F.array_distinct(F.transform(F.concat(*levels), lambda d: F.xxhash64(d))),
    }).drop(*map(p, ("paras", "leaves", "digests", "ends", "starts", "sections")))


def likeness(a: Column, b: Column, nodes_a: Column, nodes_b: Column) -> Column:
    same = F.substring(a, 1, 64) == F.substring(b, 1, 64)
    shared = F.size(F.array_intersect(nodes_a, nodes_b))
    return F.when(same, F.lit(1.0)).otherwise(2.0 * shared / (F.size(nodes_a) + F.size(nodes_b) + 2))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, key, text: the key is of id and text and never null, so all joins are plain ones on it."""
    name = F.when(F.col("doc_id").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col("doc_id").cast("string")))
    return docs.select("doc_id", F.unhex(F.md5(F.concat(name, F.lit("\n"), F.col("text")))).alias("key"), "text")


def next_documents(keyed: DataFrame) -> DataFrame:
    """(key, half, next_key) in descending doc_id, the last one's next being the first; half is half the text's code points. keyed: doc_id, key, text."""
    ranges = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("key")]
    half = F.floor(F.length("text") / 2).cast("int")
    keys = keyed.select("doc_id", "key", half.alias("half")).distinct().repartitionByRange(ranges, *order)
    keys = written(keys.withColumn("r", F.spark_partition_id()))  # the ranges are drawn from a sample: from here on they are fixed
    own = Window.partitionBy("r").orderBy(*order)
    keys = keys.withColumns({"after": F.lead("key").over(own), "place": F.row_number().over(own)})
    # One row for each range: its first key, and the first key of the range that follows.
    heads = keys.filter(F.col("place") == 1).select("r", F.col("key").alias("head"))
    over = Window.orderBy("r")
    heads = heads.select("r", F.coalesce(F.lead("head").over(over), F.first("head").over(over)).alias("head"))
    keys = keys.join(F.broadcast(heads), "r")  # as many rows as there are ranges
    return keys.select("key", "half", F.coalesce("after", "head").alias("next_key"))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, half, next_id, next_half, next_root, next_nodes) for every row of docs: doc_id, text.

    Whole texts are shuffled once, by their own key. There each text learns whose next document it is, and
    sends that document its first half-as-many code points and its tree, not itself.
    """
    keyed = _keyed(docs)
    asked = next_documents(keyed).select(F.col("key").alias("to_key"), F.col("half").alias("to_half"), F.col("next_key").alias("key"))
    sent = with_tree(keyed.join(asked, "key").select("to_key", "to_half", F.col("doc_id").alias("next_id"), "text"), "text", "next_")
    sent = sent.select("to_key", "next_id", F.substring("text", F.lit(1), F.col("to_half")).alias("next_half"), F.substring("next_fingerprint", 1, 64).alias("next_root"), "next_nodes")
    sent = sent.dropDuplicates(["to_key"]).withColumnRenamed("to_key", "key")
    return keyed.join(sent, "key").select("doc_id", "text", F.floor(F.length("text") / 2).cast("int").alias("half"), "next_id", "next_half", "next_root", "next_nodes")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every document."""
    return with_tree(whole_text(docs, "doc_id"), "text", "").select("doc_id", "fingerprint")


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """One row for each document: its fingerprint, its edited text's, and how like they and the next document's are."""
    df = with_next(whole_text(docs, "doc_id"))
    n = F.length("text")
    df = df.withColumns({"n_chars": n.cast("bigint"), "edited": F.concat(F.substring("text", F.lit(1), n - F.col("half")), "next_half")})
    df = with_tree(with_tree(df, "text", ""), "edited", "edited_")
    f, e, x = F.col("fingerprint"), F.col("edited_fingerprint"), F.col("next_root")
    return df.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(f, e, F.col("nodes"), F.col("edited_nodes")).alias("near_edited"),
        likeness(f, x, F.col("nodes"), F.col("next_nodes")).alias("near_next"), "next_id",
    )
