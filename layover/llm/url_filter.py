"""URL filter: rules first, gradient-boosted trees on lexical features else.

Features of a URL: lengths of URL, host, path and query, depth of host and
path, digit ratios, entropy of host and path, hyphens, parameter count, and
statistics of its suffixes (the host's last label, its last two, and the
last label with the first path segment): how many URLs share them and the
smoothed share of blocked ones among labelled URLs.  All statistics are
counted over all rows.

The classifier is Spark ML's gradient-boosted trees, fitted on labelled
URLs: at most ``train_rows`` of them in expectation, chosen by a hash of
the URL.  By default the labels are the verdicts of the rules (the only
labelled URLs at hand); other labels can be given.

A rule ``host/path`` fits its host and all subdomains if the URL's path
starts with the rule's path; the longest rule wins (equal lengths: the one
with the longer host).

Edge cases: a null URL or one without ``://`` has an empty host and path
and is judged by the method from its other features; with labels of one
class only, the method returns that class, without labels ``allow``;
repeated rows are judged alike; columns named in ``keep`` pass through
(others are dropped, so names cannot clash); an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layover.llm.common import prepare, staged

BROADCAST_ROWS = 200_000
PRIOR = 20.0  # rows of the prior in a suffix' share of blocked URLs
LEXICAL = ["len_url", "len_host", "len_path", "len_query", "depth_host", "depth_path", "digits_host", "digits_path",
           "entropy_host", "entropy_path", "hyphens", "params"]
SUFFIXES = ["last1", "last2", "last1_first"]


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): the host after the first ``://`` with A-Z lower-cased."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/?[^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(has, F.translate(host, upper, lower)).otherwise(""), F.when(has, path).otherwise("")


def match_rules(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls.  ``rules``:
    (verdict, rule); a list written by hand, compiled to one expression."""
    rule = verdict = F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: (len(x[1]), len(x[1].partition("/")[0]))):
        h, slash, p = r.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _entropy(s: Column) -> Column:
    """Bits per character."""
    n = F.greatest(F.length(s), F.lit(1)).cast("double")
    share = lambda c: (F.length(s) - F.length(F.replace(s, c, F.lit("")))) / n
    return F.aggregate(F.array_distinct(F.split(s, "")), F.lit(0.0),
                       lambda a, c: a - F.when((c == "") | (share(c) <= 0), 0.0).otherwise(share(c) * F.log2(share(c))))


def _digits(s: Column) -> Column:
    return (F.length(s) - F.length(F.regexp_replace(s, "[0-9]", ""))) / F.greatest(F.length(s), F.lit(1))


def lexical(url: Column, host: Column, path: Column) -> list[Column]:
    u = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(u, r"(?s)^[^?#]*\?([^#]*)", 1)
    label = F.split(host, r"\.")
    first = F.regexp_extract(path, r"^/([^/]*)", 1)
    last1, last2 = F.element_at(label, -1), F.concat_ws(".", F.slice(label, F.greatest(F.size(label) - 1, F.lit(1)), 2))
    return [F.length(u).alias("len_url"), F.length(host).alias("len_host"), F.length(path).alias("len_path"),
            F.length(query).alias("len_query"), F.size(label).alias("depth_host"),
            (F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))).alias("depth_path"),
            _digits(host).alias("digits_host"), _digits(path).alias("digits_path"),
            _entropy(host).alias("entropy_host"), _entropy(path).alias("entropy_path"),
            (F.length(host) - F.length(F.replace(host, F.lit("-"), F.lit("")))).alias("hyphens"),
            F.size(F.filter(F.split(query, "&"), lambda p: p != "")).alias("params"),
            last1.alias("last1"), last2.alias("last2"), F.concat_ws("/", last1, first).alias("last1_first")]


def judge(pages: DataFrame, rules: list[tuple[str, str]], labelled: DataFrame | None = None, url: str = "url",
          keep: tuple[str, ...] = ("page_id",), train_rows: int = 50_000, trees: int = 12, depth: int = 4, seed: int = 7) -> DataFrame:
    """``keep`` columns, host, path, rule, verdict and score (the method's
    chance of block; null where the method has no model) of every row.

    ``labelled(url, label)``: other labels (1 block, 0 allow) than the rules'."""
    prepare(pages.sparkSession)
    keep = list(keep)
    kept = [f"k{i}_" for i in range(len(keep))]

    def described(df: DataFrame) -> DataFrame:
        host, path = split_url(F.col("url_"))
        df = df.withColumns({"host": host, "path": path})
        rule, verdict = match_rules(F.col("host"), F.col("path"), rules)
        df = df.withColumns({"rule": rule, "ruled": verdict})
        return df.select("*", *lexical(F.col("url_"), F.col("host"), F.col("path")))

    p = pages.select(*[F.col(k).alias(a) for k, a in zip(keep, kept, strict=True)], F.col(url).alias("url_"))
    p = staged(described(p), "urls")
    if labelled is None:
        marked = p.where("ruled is not null").withColumn("label", (F.col("ruled") == "block").cast("double"))
    else:
        marked = described(labelled.where("label in (0, 1)").select(F.col("url").alias("url_"), F.col("label").cast("double").alias("label")))
    marked = staged(marked.select("url_", "label", *LEXICAL, *SUFFIXES), "labelled")

    total, blocked = marked.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not total or blocked in (0, total):
        only = "block" if total and blocked else "allow"
        return p.select(*[F.col(a).alias(k) for k, a in zip(keep, kept, strict=True)], "host", "path", "rule",
                        F.coalesce("ruled", F.lit(only)).alias("verdict"), F.lit(None).cast("double").alias("score"))

    def with_suffixes(df: DataFrame) -> DataFrame:
        for s in SUFFIXES:
            t = tables[s]
            df = df.join(t.withColumnRenamed("suffix", s), s, "left")
            df = df.fillna({f"{s}_rows": 0.0, f"{s}_block": float(blocked) / total})
        return df

    tables = {}
    for s in SUFFIXES:
        seen = p.groupBy(F.col(s).alias("suffix")).agg(F.log1p(F.count(F.lit(1))).alias(f"{s}_rows"))
        shares = marked.groupBy(F.col(s).alias("suffix")).agg(
            ((F.sum("label") + PRIOR * float(blocked) / total) / (F.count(F.lit(1)) + PRIOR)).alias(f"{s}_block"))
        t = staged(seen.join(shares, "suffix", "full"), "suffixes")
        tables[s] = F.broadcast(t) if t.count() <= BROADCAST_ROWS else t
    columns = LEXICAL + [f"{s}_{x}" for s in SUFFIXES for x in ("rows", "block")]
    vector = VectorAssembler(inputCols=columns, outputCol="features_", handleInvalid="keep")
    chosen = F.pmod(F.xxhash64("url_", F.lit(seed)), F.lit(1 << 30)) < int(min(1.0, train_rows / total) * (1 << 30))
    train = staged(with_suffixes(marked.where(chosen)).select("label", *columns), "train")
    if train.select("label").distinct().count() < 2:  # a small sample of one class
        train = staged(with_suffixes(marked).select("label", *columns), "train")
    model = GBTClassifier(labelCol="label", featuresCol="features_", maxIter=trees, maxDepth=depth, maxBins=64, stepSize=0.3,
                          seed=seed).fit(vector.transform(train))
    from pyspark.ml.functions import vector_to_array

    out = model.transform(vector.transform(with_suffixes(p)))
    return out.select(*[F.col(a).alias(k) for k, a in zip(keep, kept, strict=True)], "host", "path", "rule",
                      F.coalesce("ruled", F.when(F.col("prediction") > 0.5, "block").otherwise("allow")).alias("verdict"),
                      vector_to_array("probability")[1].alias("score"))
