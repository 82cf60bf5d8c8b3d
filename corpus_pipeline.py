"""Corpus pipeline over ``documents``: five stages, each written as Parquet
in the shared checkpoint folder and read again as the next one's input.

1. language: documents without a language (no letter, or a calibrated score
   below ``MIN_SCORE``) go;
2. near_duplicates: one document of each class of 5-word-shingle Jaccard
   similarity 0.8 stays, the one with the smallest doc_id; documents without
   words have no class and stay;
3. decontamination: documents that hold a benchmark item, whole or with
   edits up to a fifth of it, go;
4. personal_data: e-mail and IP addresses, card and phone numbers (and what
   the bootstrapped patterns add) are replaced by their kind in the text;
5. tokens: the texts are encoded by byte-level BPE and decoded again.

All but the last return the columns of their input.  Stage options that
read other tables take them from ``sf_dir``.  Repeated rows are one class
in stage 2; null ids and null texts are allowed everywhere (a null text has
no language); an empty table gives an empty result with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layover.llm.common import prepare, read, staged, text_key

MIN_SCORE = 0.3
BROADCAST_KEYS = 400_000

#: not expressible in SQL (trained model, embedding, merges); tested against brute force
ORACLE_SQL = None


def _marked(docs: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Left join of ``marks(_d, _t, ...)`` on the row key (doc_id, text
    hash); marks are broadcast if their number is small.  Also returns the
    marks, whose columns stay apart from equal names in ``docs``."""
    marks = staged(marks, "marks")
    if marks.count() <= BROADCAST_KEYS:
        marks = F.broadcast(marks)
    on = docs["doc_id"].eqNullSafe(marks["_d"]) & (text_key(docs["text"]) == marks["_t"])
    return docs.join(marks, on, "left"), marks


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from layover.llm.language_id import UNDECIDED, fit, held_out, predict

    prepare(spark)
    model = fit(docs, ~held_out())
    names = [f"c{i}_" for i in range(len(docs.columns))]  # the columns may have any names
    inner = docs.select(*[docs[c].alias(n) for c, n in zip(docs.columns, names, strict=True)], docs["text"])
    out = predict(inner, model, keep=tuple(names))
    out = out.where((F.col("lang_pred") != UNDECIDED) & (F.col("score") >= MIN_SCORE))
    return out.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from layover.llm.jaccard_join import jaccard_classes

    classes = jaccard_classes(docs, n=5, num=8, den=10).where("not alone")
    stays = F.col("doc_id").eqNullSafe(F.col("rep_doc")) & (F.col("th") == F.col("rep_th"))
    marks = (classes.groupBy(F.col("doc_id").alias("_d"), F.col("th").alias("_t"))
             .agg(F.max(~stays).alias("_drop"), F.count(F.lit(1)).alias("_rows")).where("_drop or _rows > 1"))
    m, marks = _marked(docs, marks)
    names = [f"c{i}_" for i in range(len(docs.columns))]
    inner = m.select(*[docs[c].alias(n) for c, n in zip(docs.columns, names, strict=True)], marks["_drop"], marks["_d"], marks["_t"])
    again = inner.where("not _drop").dropDuplicates(["_d", "_t"])
    out = inner.where("_drop is null").unionByName(again)
    return out.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from layover.llm.decontamination import contaminated, matched_documents

    hit = matched_documents(contaminated(docs, read(spark, sf_dir, "benchmark")))
    m, marks = _marked(docs, hit.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t")))
    return m.where(marks["_t"].isNull()).select(*[docs[c] for c in docs.columns])


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from layover.llm.pii import find, redact

    return redact(docs, find(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from layover.llm.bpe import decode, encode

    prepare(spark)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = encode(docs, path, public_tokenizers.PATTERN)
    out = decode(ids, path, keep=("doc_id", "id_bytes"))
    return out.select("doc_id", (F.octet_length("id_bytes") / 4).cast("long").alias("n_tokens"), "id_bytes",
                      F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
