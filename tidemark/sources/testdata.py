"""The driver's tables in recommender roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """Lazy access to the tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, str(folder).rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def inter(self) -> DataFrame:
        """Purchases: user_id, item_id, ts (seconds), seq (order within the user)."""
        return self.spark.sql(
            """SELECT o_custkey AS user_id, l_partkey AS item_id, unix_timestamp(CAST(o_orderdate AS TIMESTAMP)) AS ts,
                 CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, l_orderkey, l_linenumber, l_partkey) AS BIGINT) AS seq
               FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey""",
            orders=self.orders, lineitem=self.lineitem,
        )

    def meta(self) -> DataFrame:
        """Item metadata with missing values in fixed places."""
        return self.spark.sql(
            """SELECT p_partkey AS item_id, p_name AS title, CASE WHEN p_partkey % 19 <> 0 THEN p_type END AS main_category,
                 CASE WHEN p_partkey % 13 <> 0 THEN p_brand END AS store, CAST(p_size % 5 + 1 AS DOUBLE) AS average_rating,
                 CAST(p_size AS BIGINT) AS rating_number, CASE WHEN p_partkey % 17 <> 0 THEN p_retailprice END AS price
               FROM {part}""",
            part=self.part,
        )

    def clicks(self) -> DataFrame:
        """Interactions with documents: user_id, item_id, ts (microseconds)."""
        return self.spark.sql(
            """SELECT user_id, (event_id * 7919) % n AS item_id, unix_micros(CAST(ts AS TIMESTAMP)) AS ts
               FROM {events} CROSS JOIN (SELECT count(*) AS n FROM {documents})
               WHERE event_type IN ('view', 'click', 'purchase')""",
            events=self.events, documents=self.documents,
        )

    def texts(self) -> DataFrame:
        return self.documents.selectExpr("doc_id AS item_id", "text")

    def factors(self, odd: int) -> DataFrame:
        """Given factors: even ids are users, odd ones items."""
        return self.embeddings.where(f"vec_id % 2 = {odd}").selectExpr("vec_id AS id", "transform(embedding, x -> CAST(x AS DOUBLE)) AS f")
