"""The corpus pipeline: five stages over documents, each an operator of mergeloom.llm.

Stages take (spark, docs, sf_dir); all but the last return docs' columns, extra ones as
they are, whatever they are called. Null, empty and very long texts, repeated rows, ties
and empty tables pass through every stage; what becomes of them is said there. Rows with
a null doc_id pass the filters by their text alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeloom.llm import decontam, packing, simhash, substring, toxicity
from mergeloom.llm.queries import table, tokenizer_path
from mergeloom.llm.scratch import forget, forget_since, mark, new_path, stored

#: A document whose toxicity is at least this goes.
TOXIC = 0.3

#: No SQL can express the learned and hashed stages.
ORACLE_SQL = None


def free(docs: DataFrame, *names: str) -> list[str]:
    """Names like these that docs has no column of."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the threshold, by a model of the labelled documents among docs that op8 trains on.

    Null and empty texts are harmless. Repeated rows are kept or dropped together.
    """
    train = ~F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = toxicity.fit(docs.where(train), table(spark, sf_dir, "labels").where(train))
    return toxicity.kept(docs, model, TOXIC)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies, once; ties by a hash of the text.

    Documents without an id stay. Null and empty texts have one fingerprint, so they are
    copies of each other. Of equal rows that stay any one does.
    """
    key, root = free(docs, "key", "root")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    fps = stored(simhash.fingerprints(keyed, id_col=key), "fp")
    member = fps.join(simhash.components(fps), "fp").select(F.col("id").alias(key), F.col("root").alias(root)).dropDuplicates([key])
    rows = keyed.where("doc_id is not null").select("doc_id", key).join(member, key)
    first = rows.groupBy(root).agg(F.min(F.struct("doc_id", key)).alias("f")).select("f.doc_id", f"f.{key}")
    named = keyed.join(first, ["doc_id", key], "left_semi").dropDuplicates(["doc_id", key])
    return named.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a smaller id has; those of which nothing is left go.

    Null and empty texts, and documents without an id, stay as they are. n_chars follows the text.
    """
    key, own, left = free(docs, "key", "own", "left")
    changed = substring.deduplicated(docs).where("n_removed > 0").select(F.col("id").alias(own), F.col("rk").alias(key), F.decode("kept", "UTF-8").alias(left)).distinct()
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text")).withColumn(own, F.col("doc_id").cast("long"))
    both = keyed.join(changed, [own, key], "left").where(F.col(left).isNull() | (F.col(left) != ""))
    new = {"text": F.coalesce(left, "text"), "n_chars": F.when(F.col(left).isNotNull(), F.length(left)).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None}
    return both.select(*[(new[c].cast(t).alias(c) if c in new else F.col(c)) for c, t in docs.dtypes])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark. Repeated rows go together; null and empty texts stay."""
    key, own = free(docs, "key", "own")
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select(F.coalesce("doc_id", F.lit(0)).alias(own), F.col("rk").alias(key)).distinct()
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text")).withColumn(own, F.coalesce(F.col("doc_id").cast("long"), F.lit(0)))
    return keyed.join(found, [own, key], "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens with their places in the sequences; a null or empty text is one end token."""
    return packing.packed(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_filter),
    ("simhash", simhash_dedup),
    ("substring", substring_dedup),
    ("decontamination", benchmark_decontamination),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; what a stage wrote on its way goes when it has ended."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        point, path = mark(), new_path(spark, f"stage-{name}")
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}", path)
        forget_since(spark, point, keep=(path,))
        if before is not None:
            forget(spark, before)
        before = path
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
