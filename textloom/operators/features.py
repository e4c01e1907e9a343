"""Document-term tables, TF-IDF, n-grams and class weights as long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ngrams(tokens: Column | str, lo: int = 1, hi: int = 2) -> Column:
    """Word n-grams of an array of tokens, joined by a blank."""
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    one = lambda n: F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(F.array().cast("array<string>"))
    return F.concat(*[one(n) for n in range(lo, hi + 1)])


def char_ngrams(text: Column | str, lo: int = 3, hi: int = 5) -> Column:
    """Character n-grams inside words padded by blanks; a padded word shorter than n is taken once as it is."""
    t = F.col(text) if isinstance(text, str) else text
    words = F.filter(F.split(F.lower(F.coalesce(t, F.lit(""))), r"(?U)\s+"), lambda w: w != "")
    pad = lambda w: F.concat(F.lit(" "), w, F.lit(" "))

    def grams(w: Column) -> Column:
        p = pad(w)
        def cut(n: int) -> Column:
            return F.when(F.length(p) > n, F.transform(F.sequence(F.lit(1), F.length(p) - (n - 1)), lambda i: F.substring(p, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

        longer = [cut(n) for n in range(lo, hi + 1)]
        return F.concat(*longer, F.when(F.length(p) <= hi, F.array(p)).otherwise(F.array().cast("array<string>")))

    return F.flatten(F.transform(words, grams))


def term_counts(df: DataFrame, doc: str, terms: Column) -> DataFrame:
    """(doc, term, tf)."""
    return df.select(F.col(doc).alias("doc"), F.explode(terms).alias("term")).groupBy("doc", "term").agg(F.count("*").alias("tf"))


def tfidf(counts: DataFrame, documents: DataFrame, min_df: int = 2, max_df: float = 1.0, sublinear: bool = True) -> DataFrame:
    """(doc, term, weight): smooth idf ln((1+n)/(1+df))+1, rows of unit length; `documents` has one row `n`."""
    df_ = counts.groupBy("term").agg(F.count("*").alias("df"))
    tf = (F.log("tf") + 1) if sublinear else F.col("tf").cast("double")
    kept = df_.crossJoin(F.broadcast(documents)).where((F.col("df") >= min_df) & (F.col("df") <= F.col("n") * max_df)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    w = counts.join(kept, "term").select("doc", "term", (tf * F.col("idf")).alias("w"))
    norm = w.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, "doc").select("doc", "term", (F.col("w") / F.col("norm")).alias("weight"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, weight): n / (classes * rows of the class)."""
    g = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("c"))
    t = g.agg(F.sum("c").alias("n"), F.count("*").alias("k"))
    return g.crossJoin(F.broadcast(t)).select(label, F.round(F.col("n") / (F.col("k") * F.col("c")), 6).alias("weight"))  # one row


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec: str = "embedding", block: int = 100_000) -> DataFrame:
    """(query_id, id, cosine, rank): exact top k by cosine for a set of queries against all vectors. Queries are broadcast in blocks of about `block`, a pass over the vectors each; each partition keeps only its own best."""
    from pyspark.sql import Window

    n = queries.count()
    if n > block:
        blocks = -(-n // block) * 2  # by hash, so that none is larger than `block` but by chance
        parts = [nearest(vectors, queries.where(F.pmod(F.xxhash64(id_col), F.lit(blocks)) == i), k, id_col, vec, max(block, n)) for i in range(blocks)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
    dot = lambda a, b: F.aggregate(F.zip_with(F.col(a), F.col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    unit = lambda df, i, v: df.select(F.col(id_col).alias(i), F.col(vec).alias(v)).where(F.col(v).isNotNull())
    q = unit(queries, "query_id", "q").withColumn("nq", F.sqrt(dot("q", "q")))
    x = unit(vectors, "id", "v").withColumn("nv", F.sqrt(dot("v", "v"))).withColumn("_part", F.spark_partition_id())
    pairs = x.join(F.broadcast(q), F.col("id") != F.col("query_id")).select("query_id", "id", "_part", F.round(F.try_divide(dot("q", "v"), F.col("nq") * F.col("nv")), 6).alias("cosine"))
    order = [F.desc("cosine"), F.asc("id")]
    local = pairs.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "_part").orderBy(*order))).where(F.col("r") <= k)
    return local.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k).select("query_id", "id", "cosine", "rank")
