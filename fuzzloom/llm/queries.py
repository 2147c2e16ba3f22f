"""Queries p2, p5, p6, p7 and p8, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fuzzloom.llm.clusters import _NO_NAME, cluster
from fuzzloom.llm.cooccur import baskets, cooccurrence
from fuzzloom.llm.leaks import leaks
from fuzzloom.llm.reading import blocks_of, ratings, reading_levels, word_grades
from fuzzloom.llm.tokenizer import decode, encode
from fuzzloom.scratch import join_small


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baskets(_table(spark, sf_dir, "learning_rows"), "row_id", {"f1": "___f1"}, {"class": "___class"})


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = cooccurrence(_baskets(spark, sf_dir), (1, 500))
    big = lambda c: F.col(c).cast("decimal(38,0)")
    return pairs.filter(big("n_both") * big("n_all") >= 2 * big("n_a") * big("n_b")).select("item_a", "item_b")


def p2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs with their counts, lift and pointwise mutual information."""
    pairs = cooccurrence(_baskets(spark, sf_dir))
    return pairs.withColumn("lift", F.round("lift", 6)).withColumn("pmi", F.round("pmi", 6))


def _clusters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return cluster(_table(spark, sf_dir, "learning_rows"), "row_id", "dataset_id", "f2")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clusters(spark, sf_dir)[0].select(F.col("_k").alias("row_id"), "cluster_no")


def p5_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cluster's size, range and its three most typical records: the medoid by squared distances and those after it.

    The squared distances of a value to all members add up to the least for the member nearest to their mean (ties: the lower
    row_id).
    """
    members, found = _clusters(spark, sf_dir)
    far = F.round(F.abs(F.col("_v") - F.col("mean")), 6)
    joined = join_small(members, found, ["ds", "cluster_no"])
    ranked = joined.select("*", F.row_number().over(Window.partitionBy("ds", "cluster_no").orderBy(far, "_k")).alias("rank")).filter("rank <= 3")
    typical = F.transform(F.array_sort(F.collect_list(F.struct("rank", "_k"))), lambda s: s["_k"])
    return ranked.groupBy(F.nullif(F.col("_g"), F.lit(_NO_NAME)).alias("dataset_id"), "cluster_no", "n", "lo", "hi").agg(typical.alias("typical_row_ids"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(_table(spark, sf_dir, "documents"))


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text, encoded and decoded again; null texts come back empty."""
    return decode(p6_ids(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"))


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item that leaked, with the number of documents that hold a passage of it."""
    found = p7_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("documents"))
    return _table(spark, sf_dir, "eval_items").select("item_id", "suite", "lang").distinct().join(found, "item_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_levels(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "reading_labels"))


def p8_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grade at which each word is acquired, as each fold of the documents is told it."""
    grades = word_grades(blocks_of(_table(spark, sf_dir, "documents")), ratings(_table(spark, sf_dir, "reading_labels")))
    return grades.select("word", F.posexplode("grades").alias("fold", "grade")).filter("grade IS NOT NULL").withColumn("grade", F.round("grade", 9))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p2_found": p2_found, "p2_pairs": p2_pairs, "p5_found": p5_found, "p5_clusters": p5_clusters, "p6_ids": p6_ids, "p6_decoded": p6_decoded, "p7_found": p7_found, "p7_items": p7_items, "p8_found": p8_found, "p8_grades": p8_grades}


_ITEMS = """
WITH once AS (SELECT row_id, any_value(f1) AS f1, any_value("class") AS c FROM learning_rows GROUP BY row_id),
items AS (
  SELECT DISTINCT row_id, trim(lower(v)) || '___f1' AS item FROM (SELECT row_id, unnest(string_split(f1, '|')) AS v FROM once) WHERE trim(lower(v)) <> ''
  UNION ALL SELECT row_id, trim(lower(c)) || '___class' FROM once WHERE trim(lower(c)) <> ''
),
total AS (SELECT count(*) AS n_all FROM once),
one AS (SELECT item, count(*) AS n FROM items GROUP BY item),
two AS (SELECT a.item AS item_a, b.item AS item_b, count(*) AS n_both FROM items a JOIN items b ON a.row_id = b.row_id AND a.item < b.item GROUP BY 1, 2),
pairs AS (
  SELECT item_a, item_b, n_both, a.n AS n_a, b.n AS n_b, n_all
  FROM two JOIN one a ON a.item = item_a JOIN one b ON b.item = item_b CROSS JOIN total
)
"""

#: By trying every gap of a dataset as the cut: quadratic in its records, for small tables.
_CUTS = """
WITH x AS (SELECT row_id, coalesce(any_value(dataset_id), chr(1)) AS ds, any_value(f2) AS v FROM learning_rows GROUP BY row_id),
s AS (
  SELECT *, v - lag(v) OVER (PARTITION BY ds ORDER BY v, row_id) AS g, count(*) OVER (PARTITION BY ds) AS n
  FROM x WHERE v IS NOT NULL AND NOT isnan(v) AND NOT isinf(v)
),
t AS (SELECT ds, t, lead(t) OVER (PARTITION BY ds ORDER BY t) AS following, min(t) FILTER (WHERE t > 0) OVER (PARTITION BY ds) AS finest FROM (SELECT DISTINCT ds, coalesce(g, 0) AS t FROM s UNION SELECT DISTINCT ds, 0 FROM s)),
a AS (SELECT s.ds, t, following, finest, n, v, sum((coalesce(g, 0) > t)::INT) OVER (PARTITION BY s.ds, t ORDER BY v, row_id) AS grp FROM s JOIN t ON s.ds = t.ds),
b AS (SELECT ds, t, following, finest, n, grp, count(*) AS c, min(v) AS lo, max(v) AS hi FROM a GROUP BY ALL),
k AS (SELECT ds, t, following, finest, max(hi - lo) FILTER (WHERE c >= 5) AS w, min(c) FILTER (WHERE c >= 5) AS smallest, coalesce(sum(c) FILTER (WHERE c < 5), 0) AS strays FROM b GROUP BY ALL),
good AS (SELECT ds, min(t) AS t FROM k WHERE strays < smallest AND following > w + coalesce(finest, 0) GROUP BY ds),
cut AS (SELECT k.ds, coalesce(any_value(good.t), max(k.t)) AS t FROM k LEFT JOIN good ON k.ds = good.ds GROUP BY k.ds),
c AS (SELECT b.ds, lo, hi, c AS n, (row_number() OVER (PARTITION BY b.ds ORDER BY lo) - 1)::INT AS cluster_no FROM b JOIN cut ON b.ds = cut.ds AND b.t = cut.t WHERE c >= 5)
"""


_GRADES = r"""
WITH votes AS (SELECT doc_id, reading_level AS k, count(DISTINCT coalesce(rater, '')) AS n FROM reading_labels WHERE doc_id IS NOT NULL AND reading_level BETWEEN 1 AND 4 GROUP BY ALL),
rated AS (SELECT doc_id, k, doc_id % 5 AS part FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, k) AS best FROM votes) WHERE best = 1),
met AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower("text"), '[\p{L}\p{Nl}\p{No}]+')) AS word FROM documents),
folds AS (SELECT unnest(range(5)) AS fold),
size AS (SELECT fold, k, count(*) AS d FROM rated, folds WHERE part <> fold GROUP BY ALL),
total AS (SELECT fold, sum(d) AS d FROM size GROUP BY ALL),
n AS (SELECT word, fold, k, count(*) AS n FROM met JOIN rated USING (doc_id), folds WHERE part <> fold GROUP BY ALL),
words AS (SELECT word, fold, sum(n) AS n FROM n GROUP BY ALL HAVING sum(n) >= 5),
share AS (SELECT w.word, w.fold, l.k, coalesce(n.n * total.d / 4.0::DOUBLE / size.d, 0) + 0.5 AS s
  FROM words w CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS k) l JOIN total ON total.fold = w.fold LEFT JOIN size ON size.fold = w.fold AND size.k = l.k LEFT JOIN n ON n.word = w.word AND n.fold = w.fold AND n.k = l.k)
SELECT word, fold::INT AS fold, round(sum(k * s) / sum(s), 9) AS grade FROM share GROUP BY ALL"""


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": _CUTS + "SELECT row_id, cluster_no FROM s JOIN c ON s.ds = c.ds AND v BETWEEN lo AND hi",
        "p5_clusters": _CUTS + """, m AS (SELECT s.ds, cluster_no, c.n, lo, hi, row_id, v, avg(v) OVER (PARTITION BY s.ds, cluster_no) AS mean FROM s JOIN c ON s.ds = c.ds AND v BETWEEN lo AND hi),
r AS (SELECT *, row_number() OVER (PARTITION BY ds, cluster_no ORDER BY round(abs(v - mean), 6), row_id) AS k FROM m)
SELECT nullif(ds, chr(1)) AS dataset_id, cluster_no, n, lo, hi, list(row_id ORDER BY k) AS typical_row_ids FROM r WHERE k <= 3 GROUP BY ALL""",
        "p8_grades": _GRADES,
        "p6_decoded": "SELECT doc_id, coalesce(\"text\", '') AS \"text\" FROM documents",
        "p2_found": _ITEMS + "SELECT item_a, item_b FROM pairs WHERE n_both * 500 >= n_all AND n_both::HUGEINT * n_all >= 2 * n_a::HUGEINT * n_b",
        "p2_pairs": _ITEMS + "SELECT item_a, item_b, n_both, n_a, n_b, n_all, round(n_both::DOUBLE * n_all / n_a / n_b, 6) AS lift, round(log2(n_both::DOUBLE * n_all / n_a / n_b), 6) AS pmi FROM pairs",
    }
