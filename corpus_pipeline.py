"""Documents on their way to a training mix, in five stages.

Each stage takes what its predecessor kept, stored as Parquet and read again. All but the last return the
columns of documents. Empty tables pass through every stage; NULL texts are treated as empty ones and stay
NULL; extra columns are kept, unless the last stage's carry their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm import decontaminate, mixing, pii, simhash, toxicity
from plumbline.llm.texts import small_side, stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]).alias("__row")
    scored = toxicity.toxicity_scores(docs.select("doc_id", "text", others), _table(spark, sf_dir, "labels"))
    kept = scored.where("predicted = 0")
    return kept.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"__row.`{c}`") for c in docs.columns])


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest doc_id stays, of repeated rows one.

    The ids that go are joined, not the ones that stay. Only ids on several rows, and NULL, need their
    fingerprint to tell which row is meant; groups are told apart by their root, as such ids can be the
    smallest of several groups.
    """
    found = stored(simhash.near_duplicates(docs), "near-duplicates")
    kept = found.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("all_stay")
    )
    gone = stored(kept.where("n = 1 AND NOT all_stay AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__id")), "gone")
    several = stored(kept.where("n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("__id")), "several")
    same = F.col("doc_id").eqNullSafe(F.col("__id"))
    if not several.take(1):
        return docs.join(small_side(gone), same, "left_anti")
    clear = docs.join(small_side(gone.union(several)), same, "left_anti")
    chosen = (
        found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .join(small_side(several), same, "left_semi")
        .groupBy("doc_id", "root")
        .agg(F.min("bits").alias("bits"))
    )
    wrapped = docs.join(small_side(several), same, "left_semi").select(
        "doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    )
    marked = simhash.fingerprints(wrapped).select(F.col("doc_id").alias("__id"), F.col("bits").alias("__bits"), "__row")
    matched = marked.join(chosen, same & (F.col("bits") == F.col("__bits")), "left_semi")
    rows = matched.groupBy("__id", "__bits").agg(F.min_by("__row", F.xxhash64("__row.text")).alias("__row"))
    return clear.unionByName(rows.select("__row.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any occurrence of a benchmark window go."""
    wrapped = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    found = decontaminate.contamination(wrapped, _table(spark, sf_dir, "benchmark"))
    return found.where(F.size("hit_words") == 0).select("__row.*")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the text gives way to the name of its kind; ``n_chars`` follows."""
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("__row")
    found = pii.find_pii(docs.select("text", rest), redact=True)
    columns = [F.col("redacted_text").alias("text") if c == "text" else F.col(f"__row.`{c}`") for c in docs.columns]
    redacted = found.select(*columns)
    if "n_chars" in docs.columns:
        redacted = redacted.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return redacted.select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes: their columns, ``copies``, and ``size``, ``source_size``, ``target``
    and ``taken`` in words. A document that is repeated is one row with its number of copies."""
    sized = docs.drop("size").withColumn("size", mixing.word_count("text"))
    return mixing.mix(sized).where("copies > 0")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", keep_one_of_each),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("mix_sources", mix_sources),
]

#: SQL has neither the language model nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
