"""The corpus pipeline: language, quality, near-duplicates, mixture, tokens; each stage works on what the last kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet in the folder that the
cluster shares and reads again for the next stage. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import bpe, langid, mixing, quality, similar
from tidemark.llm.common import cut, shared_dir
from tidemark.llm.queries import WORD_VOCABULARY, fold, table, vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Near-duplicates have an exact Jaccard similarity of 4/5 or more between their sets of five-word shingles.
SHINGLE_WORDS = 5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is clear: those without letters and the ambiguous ones go.

    A row is judged by its whole text alone: null, empty and blank texts go, texts of any length are read to their end, a
    null or repeated id changes nothing, and repeated rows share one fate. Rows with a null lang are judged, not learned
    from. Only the columns of documents pass; an empty table stays empty.
    """
    model = langid.train(docs, fold(4) != 2)
    found = langid.identify(docs, model)
    return found.where("lang_pred != 'und' and not ambiguous").select(COLUMNS)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the quality network scores 0.3 or more.

    A row is judged by its whole text alone (null and empty: a run of zero bytes), whether its id is labelled, null or
    repeated, so repeated rows share one fate. Without labels of one kind all documents get the same score. Only the
    columns of documents pass; an empty table stays empty.
    """
    net = quality.train(docs, table(spark, sf_dir, "labels"), fold(5) != 0)
    return quality.score(docs, net).where("score >= 0.3").select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates: the one with the smallest id, null last.

    A group is what chains of pairs connect that SimHash finds and an exact similarity of 0.8 or more confirms. Ids only
    choose within a group: texts of other groups stay, whether their id is null or repeated. Of repeated rows, and of rows
    that tie in id and text, one stays. Null, empty and blank texts are one group. Rows are told apart by a 64-bit hash
    of id and text; among 10**10 documents two or three may share theirs, and one of them is lost. An empty table stays
    empty.
    """
    tagged = docs.withColumn("tag", F.xxhash64("doc_id", "text"))
    found = cut(similar.similar_texts(tagged, SHINGLE_WORDS))
    rows = tagged.select("tag", "doc_id").join(found.hint("merge"), "tag")
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")).alias("x")).select("x.tag")
    # the list grows with the corpus: never broadcast, whatever its size here
    return tagged.join(first.hint("merge"), "tag", "left_semi").dropDuplicates(["tag"]).select(COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as the mixture of sources does: not at all, once or twice.

    Documents are told apart by id (null too), text and source. Copies of rows that agree in all three differ by one
    at most; the first rows in order of their other columns get the more, in one task for each such set of rows (the
    stage before leaves one row of each text). Texts without words count as size 0; a null source is one more source. An
    empty table stays empty.
    """
    key = F.xxhash64("tag", F.col("source").cast("string"))
    copies = mixing.mix(docs).groupBy(key.alias("key")).agg(F.min("copies").alias("low"), (F.sum("copies") - F.min("copies") * F.count(F.lit(1))).alias("more")).where("low + more > 0")
    keyed = docs.withColumn("tag", F.xxhash64("doc_id", "text")).withColumn("key", key)
    numbered = keyed.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("lang", "n_chars")))
    taken = numbered.join(copies.hint("merge"), "key").withColumn("copies", F.col("low") + (F.col("n") <= F.col("more")).cast("long")).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document taken, with digests of the ids and of the text they decode to; null and empty texts have no
    ids, repeated rows are encoded each, an empty table gives no rows."""
    return bpe.round_trip(docs.select("doc_id", "source", "text"), vocabulary(WORD_VOCABULARY), keep_ids=True)


STAGES = [
    ("language ID", language),
    ("quality classifier", good_quality),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources", mixture),
    ("BPE encoding", tokens),
]

#: Fingerprints, trained models and balanced sampling are beyond SQL; tests hold the stages to brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
