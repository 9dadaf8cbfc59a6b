"""A synthetic graph of products, features and regions, 25 quads an entity, made on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as t

#: Names, fan-outs and query texts of the published benchmark.
ENTITY, PROPERTY = "https://www.wikidata.org/entity/", "https://www.wikidata.org/prop/direct/"
FEATURES, CLASSES, REGIONS, LINKS = 20, 50, 500, 3


def quads(spark: SparkSession, entities: int) -> DataFrame:
    """Per entity i: a class, a region, twenty features, and links to the three entities after it."""
    i = F.col("id")

    def node(prefix: str, n: Column) -> Column:
        return t.iri(F.concat(F.lit(ENTITY + prefix), n.cast("string")))

    def quad(p: str, o: Column) -> Column:
        return F.struct(F.lit(None).cast("string").alias("g"), node("entity", i).alias("s"), F.lit(PROPERTY + p).alias("p"), o.alias("o"))

    made = [quad("P31", node("class", i % CLASSES)), quad("P131", node("region", i % REGIONS))]
    made += [quad("P2", node("feature", (i * FEATURES + k) % 2000)) for k in range(FEATURES)]
    made += [quad("related", node("entity", (i + k) % entities)) for k in range(1, LINKS + 1)]
    return spark.range(entities).select(F.explode(F.array(*made)).alias("q")).select("q.*")


QUERIES = {
    "scan": "SELECT * WHERE { ?s wdt:P31 ?o }",
    "2join": "SELECT ?s ?region WHERE { ?s wdt:P31 wd:class0 . ?s wdt:P131 ?region }",
    "feature_lookup": "SELECT ?p WHERE { ?p wdt:P2 wd:feature0 }",
    "star_with_features": "SELECT ?p ?f WHERE { ?p wdt:P31 wd:class0 . ?p wdt:P2 ?f }",
    "path_2hop": "SELECT ?a ?b ?c WHERE { ?a wdt:related ?b . ?b wdt:related ?c }",
    "triangle": "SELECT ?a ?b ?c WHERE { ?a wdt:related ?b . ?b wdt:related ?c . ?a wdt:related ?c }",
}
PREFIXES = {"wd": ENTITY, "wdt": PROPERTY}
