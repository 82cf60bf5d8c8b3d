"""The thin queries ``opN_<name>`` of the driver contract.

Each applies one operator with its production parameters to the whole
table and derives the contract's columns from the operator's output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layover.llm.common import prepare, read


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from layover.llm.jaccard_join import jaccard_classes

    prepare(spark)
    c = jaccard_classes(read(spark, sf_dir, "documents"), n=3, num=90, den=100)
    return c.select("doc_id", "n_shingles", F.col("class_id").alias("component_id"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from layover.llm.html_extraction import extract

    prepare(spark)
    t = extract(read(spark, sf_dir, "pages"))
    return t.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from layover.llm.language_id import held_out, identify

    docs = read(prepare(spark), sf_dir, "documents")
    return identify(docs).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


#: rules of the contract: (verdict, host/path)
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
             ("block", "net/es/"), ("block", "net/fr/")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from layover.llm.url_filter import judge

    return judge(read(prepare(spark), sf_dir, "pages"), URL_RULES)


def op5_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from layover.llm.bpe import decode, encode

    prepare(spark)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = encode(read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    out = decode(ids, path, keep=("doc_id", "id_bytes"))
    return out.select("doc_id", (F.octet_length("id_bytes") / 4).cast("long").alias("n_tokens"),
                      F.sha2("id_bytes", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from layover.llm.sharding import shard_rows

    return shard_rows(read(spark, sf_dir, "documents"), 16)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from layover.llm.quality import judge

    prepare(spark)
    q = judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from layover.llm.decontamination import contaminated

    prepare(spark)
    m = contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return m.select("doc_id", "item_id", "distance", "length", "start", "end")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from layover.llm.common import scratch
    from layover.llm.warc import read_archives, with_full_payload, write_archives

    path = write_archives(read(spark, sf_dir, "pages"), scratch(prepare(spark), "archives"))
    r = with_full_payload(read_archives(spark, path))
    return r.select(F.col("row_id").alias("page_id"), "payload_bytes", "payload_digest",
                    F.col("type").alias("record_type"), F.col("refers_to_row").alias("refers_to"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from layover.llm.pii import KINDS, find

    f = find(read(prepare(spark), sf_dir, "documents"))
    name = F.array(*[F.lit(k) for k in KINDS])
    joined = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", name[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return f.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
                    F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
                    joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from layover.llm.hard_negatives import mine, relabelled, taking_part

    rows = taking_part(relabelled(read(prepare(spark), sf_dir, "embeddings")))
    return mine(rows, F.col("vec_id") % 100 == 0)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from layover.llm.toxicity import fit, held_out, predict

    docs = read(prepare(spark), sf_dir, "documents")
    scored = predict(docs, fit(docs, read(spark, sf_dir, "labels"), ~held_out(), at=0.7))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from layover.llm.conversation_repair import conversation_key, damage, digest, gaps, repair, turns

    given = read(prepare(spark), sf_dir, "conversations")
    rows = turns(damage(given))
    edits, faults = repair(rows)
    every = given.select(conversation_key().alias("key"), "conv_id").dropDuplicates(["key"])
    x = every.join(gaps(rows), "key", "left").join(faults, "key", "left").join(digest(edits), "key", "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return x.select("conv_id", *[number(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                    F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_html_extraction": op2_html_extraction,
    "op3_language_id": op3_language_id,
    "op4_url_filter": op4_url_filter,
    "op5_byte_level_bpe": op5_byte_level_bpe,
    "op6_sharding": op6_sharding,
    "op7_quality_rules": op7_quality_rules,
    "op8_decontamination": op8_decontamination,
    "op9_warc": op9_warc,
    "op10_pii": op10_pii,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_toxicity": op12_toxicity,
    "op13_conversation_repair": op13_conversation_repair,
}
