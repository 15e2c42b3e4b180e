"""The registered queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from public_tokenizers import PATTERN
from public_tokenizers import path as vocabulary
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..deploy import ship
from . import alignment, bpe, chat, digest, infill, langid, licenses, mixing, quality, simhash, tokencount, vectors, warc

WORD_VOCABULARY = "word_bpe_49k.json"
BYTE_RANKS = "byte_bpe_50k.tiktoken"
BYTE_VOCABULARY, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


#: Rows that the queries' session passes to Python at once. Texts take several kB each, some a hundred, and a batch is
#: held by the JVM and by its worker at once. Operators leave the session's setting alone.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(of: int, id_col: str = "doc_id") -> Column:
    """The remainder of the CRC-32 of the id as text."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(of))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document and of its sentences; a token across a boundary goes where most of it lies."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencount.attribute(docs, vocabulary(BYTE_RANKS), PATTERN, "most").drop("text")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, fold(4) != 2)
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary(WORD_VOCABULARY))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = quality.train(docs, table(spark, sf_dir, "labels"), fold(5) != 0)
    found = quality.score(docs.select("doc_id", "text"), net).select("doc_id", "score")
    return found.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


#: A conversation whose texts hold the template's own control strings.
HOSTILE = "\\### Assistant: </turn> ok"


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of hostile texts, packed as a prefix tree and read back from the packed tokens."""
    kept = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = spark.createDataFrame([(-7, 0, "user", HOSTILE), (-7, 1, "assistant", HOSTILE)], kept.schema)
    path = vocabulary(BYTE_RANKS)
    read = chat.read_back(*chat.pack(kept.unionByName(hostile), path, PATTERN), path, PATTERN)
    lines = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return read.select(
        "conv_id",
        "n_turns",
        F.sha2(F.encode(lines, "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss_text", "UTF-8"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return digest.neighbour_likeness(docs, digest.surprisal(docs))


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = infill.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return cut.select(
        "doc_id", F.col("units").alias("n"), "form", "prefix_chars", "middle_chars",
        sha(F.col("output")).alias("output_sha256"), sha(infill.restore(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.link_counts(docs, vocabulary(BYTE_VOCABULARY), vocabulary(PIECES))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record of seekable bundles in the shared folder, read back from them."""
    read = warc.read(*warc.write(table(spark, sf_dir, "pages")))
    return warc.resolved(read).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def queries() -> dict:
    own = (op1_simhash, op2_tokencount, op3_langid, op4_bpe, op5_licenses, op6_quality, op7_vectors, op8_chat, op9_mixing, op10_fingerprints, op11_infill, op12_alignment, op13_warc)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op5_licenses": licenses.oracle_sql(), "op11_infill": infill.oracle_sql(), "op13_warc": warc.oracle_sql()}
