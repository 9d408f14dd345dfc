"""Article listings: newest, by category, by author, related."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarifflens.operators.history import newest


def latest_articles(articles: DataFrame, limit: int = 6) -> DataFrame:
    return articles.orderBy(F.desc("published"), "article_id").limit(limit)


def by_author(articles: DataFrame) -> DataFrame:
    """All articles, newest first inside each author: a range sort, so a prolific author spreads."""
    return articles.orderBy("author", F.desc("published"), "article_id")


def newest_per_category(articles: DataFrame, k: int = 3) -> DataFrame:
    tagged = articles.select("article_id", "published", F.explode("tags").alias("tag"))
    return newest(tagged, ["tag"], [F.desc("published"), F.asc("article_id")], k, rank="rank")


def related_articles(articles: DataFrame, k: int = 3) -> DataFrame:
    """The newest ``k`` other articles that share a category, for every article.

    Only the newest ``k + 1`` of each category can be an answer, so each article meets at
    most that many per tag: no pairing inside a category.
    """
    tagged = articles.select("article_id", F.explode(F.array_distinct("tags")).alias("tag"))
    heads = newest_per_category(articles.withColumn("tags", F.array_distinct("tags")), k + 1)
    short = heads.groupBy("tag").agg(F.collect_list(F.struct("published", "article_id")).alias("heads"))
    met = tagged.join(short, "tag").select("article_id", "heads")
    # An article has few tags, hence few short lists.
    lists = met.groupBy("article_id").agg(F.array_distinct(F.flatten(F.collect_list("heads"))).alias("pool"))
    others = F.filter("pool", lambda x: x["article_id"] != F.col("article_id"))
    keyed = F.array_sort(
        F.transform(others, lambda x: F.struct((-x["published"]).alias("age"), x["article_id"].alias("related_id")))
    )
    return lists.select("article_id", F.posexplode(F.slice(keyed, 1, k)).alias("i", "r")).select(
        "article_id", (F.col("i") + 1).cast("bigint").alias("rank"), "r.related_id"
    )
