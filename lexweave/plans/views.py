"""Views on the driver's tables that stand for tag and work dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import cut
from ..operators import audit, graph, sampling
from ..operators.matching import representations

SEED = "lexweave-v1"
#: Size of the evaluation sample and its cap per canonical.
SAMPLE, CAP = 2000, 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags from parts: groups of ten around a base name, with aliases, conflicts, chains, cycles and missing targets."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size").withColumn("g", F.expr("p_partkey div 10")).withColumn("pos", F.col("p_partkey") % 10)
    bases = p.filter("pos = 0").select("g", F.concat_ws(" ", "p_name", "p_brand", "g").alias("base"))
    j = p.join(bases, "g").withColumn("id", F.col("p_partkey") + 1)
    g, pos, base, i = F.col("g"), F.col("pos"), F.col("base"), F.col("id")
    name = (
        F.when(pos == 0, base).when(pos == 1, F.upper(base)).when(pos == 2, F.replace(base, F.lit(" "), F.lit("-"))).when(pos == 3, F.concat(F.lit("my "), base))
        .when(pos == 4, F.concat(base, F.lit("s"))).when(pos == 5, F.col("p_name")).when(pos == 6, F.concat_ws(" ", "p_name", "p_brand", "id"))
        .when(pos == 7, audit.REDACTED).otherwise(F.concat(F.lower(base), F.lit("!")))
    )
    eight = F.when(g % 5 == 0, i - 8).when(g % 5 == 1, i + 10_000_000).when(g % 5 == 2, i + 1).when(g % 5 == 3, i + 2).otherwise(i)
    link = F.when(pos.isin(1, 2, 3, 7), i - pos).when(pos == 4, i - 1).when(pos == 8, eight).when(pos == 9, F.when((g % 5).isin(0, 2), i - 1).otherwise(i - 9))
    return j.select(
        i.cast("long").alias("id"), F.when(g % 2 == 0, "Freeform").when(g % 4 == 1, "Character").otherwise("Fandom").alias("type"), name.alias("name"),
        (pos.isin(0, 6) | ((pos == 8) & (g % 5 == 0))).alias("canonical"), F.col("p_size").cast("long").alias("cached_count"), link.cast("long").alias("merger_id"),
    )


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus", "o_totalprice")
    return o.select(
        (F.col("o_orderkey") + 1).cast("long").alias("ordinal"), F.to_date("o_orderdate").alias("creation_date"), F.substring("o_orderpriority", 1, 1).alias("language"),
        (F.col("o_orderstatus") == "P").alias("restricted"), (F.col("o_orderstatus") == "F").alias("complete"),
        F.when(F.col("o_orderkey") % 50 != 0, F.floor("o_totalprice").cast("long")).alias("word_count"),
    )


def work_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    return li.select((F.col("l_orderkey") + 1).cast("long").alias("ordinal"), (F.col("l_partkey") + 1).cast("long").alias("tag_id")).distinct()


class Host:
    """The dumps and what is derived from them, for one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.tags = tags(spark, sf_dir)
        self._resolved = self._synonyms = self._queries = None

    @property
    def resolved(self) -> DataFrame:
        if self._resolved is None:
            self._resolved = graph.resolve_links(self.tags)
        return self._resolved

    @property
    def catalogue(self) -> DataFrame:
        return audit.catalogue(self.tags)

    @property
    def synonyms(self) -> DataFrame:
        if self._synonyms is None:
            self._synonyms = cut(audit.eligible_synonyms(self.tags, self.resolved))
        return self._synonyms

    @property
    def freeform(self) -> DataFrame:
        return self.catalogue.filter("type = 'Freeform'")

    @property
    def aliases(self) -> DataFrame:
        return self.synonyms.filter("type = 'Freeform'")

    @property
    def queries(self) -> DataFrame:
        """The evaluation sample: (query_id, query_name, canonical_id, cached_count, canonical_name)."""
        if self._queries is None:
            s = sampling.capped_sample(self.aliases, "id", "canonical_id", SEED, SAMPLE, CAP, strict=False)
            self._queries = cut(s.select(F.col("id").alias("query_id"), F.col("name").alias("query_name"), "canonical_id", "cached_count", "canonical_name"))
        return self._queries

    @property
    def names(self) -> DataFrame:
        return representations(self.freeform)

    @property
    def names_and_aliases(self) -> DataFrame:
        return representations(self.freeform, self.aliases)

    @property
    def works(self) -> DataFrame:
        return works(self.spark, self.sf_dir)

    @property
    def work_tags(self) -> DataFrame:
        return work_tags(self.spark, self.sf_dir)
