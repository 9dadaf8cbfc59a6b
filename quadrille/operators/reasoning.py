"""OWL 2 RL subset: forward chaining to a fixpoint, consistency checks, and owl:sameAs classes.

Rules are joins of the triples with the small schema part. Each round joins only what the last one found with all that is
known; rounds end when nothing new comes. Inferred triples belong to the default graph.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import terms as t
from ..plans.algebra import OWL, RDF, RDFS
from ..sources.dataset import Dataset, distinct
from .paths import cut

TYPE, SUB_CLASS, SUB_PROPERTY = RDF + "type", RDFS + "subClassOf", RDFS + "subPropertyOf"


def _pairs(triples: DataFrame, predicate: str, a: str, b: str) -> DataFrame:
    """IRIs of a schema relation: (a, b) texts."""
    return triples.where(F.col("p") == predicate).select(F.col("s")["lex"].alias(a), F.col("o")["lex"].alias(b))


def _typed(triples: DataFrame, cls: str) -> DataFrame:
    return triples.where((F.col("p") == TYPE) & (F.col("o")["lex"] == cls)).select(F.col("s")["lex"].alias("prop"))


#: What makes each rule worth a look: predicates of the schema, and classes of properties.
TRIGGERS = {OWL + n for n in ("equivalentClass", "equivalentProperty", "inverseOf", "SymmetricProperty", "TransitiveProperty")} | {SUB_CLASS, SUB_PROPERTY, RDFS + "domain", RDFS + "range"}


def _present(triples: DataFrame) -> set[str]:
    """The triggers that occur among the triples, at most one row each."""
    o = F.col("o")["lex"]
    named = F.when(F.col("p") == TYPE, o).otherwise(F.col("p"))
    found = {r[0] for r in triples.select(named.alias("t")).where(F.col("t").isin(*sorted(TRIGGERS))).distinct().collect()}
    # Equivalence makes inclusions.
    return found | {sub for eq, sub in ((OWL + "equivalentClass", SUB_CLASS), (OWL + "equivalentProperty", SUB_PROPERTY)) if eq in found}


def _step(new: DataFrame, all_: DataFrame, present: set[str]) -> list[DataFrame]:
    """Conclusions with at least one premise among the new triples, of the rules whose triggers are present."""
    out: list[DataFrame] = []

    def both(trigger: str, rule) -> None:
        if trigger in present:
            out.append(rule(new, all_))
            out.append(rule(all_, new))

    iri = t.iri
    node = lambda n: new.where(F.col("p") == n)
    s, p, o = F.col("s"), F.col("p"), F.col("o")

    def chained(a: DataFrame, b: DataFrame, first: str, sub: str) -> DataFrame:
        """a first m, m sub o: a first o."""
        return a.where(p == first).select("s", F.col("o").alias("m")).join(b.where(p == sub).select(F.col("s").alias("m"), "o"), "m").select("s", F.lit(first).alias("p"), "o")

    # equivalence gives inclusion both ways
    for eq, sub in ((OWL + "equivalentClass", SUB_CLASS), (OWL + "equivalentProperty", SUB_PROPERTY)):
        if eq in present:
            out.append(node(eq).select("s", F.lit(sub).alias("p"), "o"))
            out.append(node(eq).select(o.alias("s"), F.lit(sub).alias("p"), s.alias("o")))
    # transitivity of inclusion, and types through it
    for sub in (SUB_CLASS, SUB_PROPERTY):
        both(sub, lambda a, b, sub=sub: chained(a, b, sub, sub))
    both(SUB_CLASS, lambda a, b: chained(a, b, TYPE, SUB_CLASS))
    # triples through property inclusion, inverses, domains and ranges
    both(SUB_PROPERTY, lambda a, b: a.join(_pairs(b, SUB_PROPERTY, "pa", "pb"), F.col("p") == F.col("pa")).select("s", F.col("pb").alias("p"), "o"))
    for pa, pb in (("pa", "pb"), ("pb", "pa")):
        both(OWL + "inverseOf", lambda a, b, pa=pa, pb=pb: a.join(_pairs(b, OWL + "inverseOf", pa, pb), F.col("p") == F.col("pa")).select(F.col("o").alias("s"), F.col("pb").alias("p"), F.col("s").alias("o")))
    both(RDFS + "domain", lambda a, b: a.join(_pairs(b, RDFS + "domain", "pa", "c"), F.col("p") == F.col("pa")).select("s", F.lit(TYPE).alias("p"), iri(F.col("c")).alias("o")))
    both(RDFS + "range", lambda a, b: a.join(_pairs(b, RDFS + "range", "pa", "c"), F.col("p") == F.col("pa")).where(o["k"] != t.LITERAL).select(F.col("o").alias("s"), F.lit(TYPE).alias("p"), iri(F.col("c")).alias("o")))
    # symmetric and transitive properties
    both(OWL + "SymmetricProperty", lambda a, b: a.join(_typed(b, OWL + "SymmetricProperty"), F.col("p") == F.col("prop")).select(F.col("o").alias("s"), "p", F.col("s").alias("o")))
    if OWL + "TransitiveProperty" in present:
        links = all_.join(_typed(all_, OWL + "TransitiveProperty"), F.col("p") == F.col("prop"))
        fresh = new.join(_typed(all_, OWL + "TransitiveProperty"), F.col("p") == F.col("prop"))
        late = all_.join(_typed(new, OWL + "TransitiveProperty"), F.col("p") == F.col("prop"))
        for a, b in ((fresh, links), (links, fresh), (late, links)):
            out.append(a.select("p", "s", F.col("o").alias("m")).join(b.select("p", F.col("s").alias("m"), "o"), ["p", "m"]).select("s", "p", "o"))
    return [x.where(F.col("s")["k"] != t.LITERAL) for x in out]


def infer(dataset: Dataset) -> DataFrame:
    """Inferred triples (s, p, o) that are not asserted in any graph. Rules make no new terms, so the rounds come to an end."""
    base = cut(distinct(dataset.quads.select("s", "p", "o"), dataset.most))
    total, new = base, base
    present: set[str] = set()
    while True:
        present |= _present(new)
        steps = _step(new, total, present)
        if not steps:
            break
        made = reduce(DataFrame.union, steps).distinct()
        new = cut(made.join(total, ["s", "p", "o"], "left_anti"))
        if new.isEmpty():
            break
        total = cut(total.union(new))
    return total.join(base, ["s", "p", "o"], "left_anti")


def with_inferences(dataset: Dataset) -> Dataset:
    """The dataset with inferred triples in its default graph."""
    more = infer(dataset).select(F.lit(None).cast("string").alias("g"), "s", "p", "o")
    return Dataset(dataset.quads.select("g", "s", "p", "o").union(more), dataset.graphs)


def violations(dataset: Dataset) -> DataFrame:
    """Inconsistencies: (rule, message, severity), one row per finding."""
    # What is inferred is as a rule of the order of what is said; more of it makes larger tasks, no other rows.
    q = cut(distinct(with_inferences(dataset).quads.select("s", "p", "o"), dataset.most))
    text = lambda c: t.text_of(F.col(c))
    a, b = q.alias("a"), q.alias("b")
    asym = q.join(_typed(q, OWL + "AsymmetricProperty"), F.col("p") == F.col("prop")).select("s", "p", "o")
    turned = asym.select(F.col("o").alias("s"), "p", F.col("s").alias("o"))
    clash = asym.join(turned, ["s", "p", "o"]).where(text("s") <= text("o"))
    found = [
        clash.select(F.lit("prp-asyp").alias("rule"), F.concat(text("s"), F.lit(" and "), text("o"), F.lit(" are joined both ways by "), F.col("p")).alias("message")),
        q.join(_typed(q, OWL + "IrreflexiveProperty"), F.col("p") == F.col("prop")).where("s = o").select(F.lit("prp-irp"), F.concat(text("s"), F.lit(" is joined with itself by "), F.col("p"))),
    ]
    types = q.where(F.col("p") == TYPE).select("s", F.col("o")["lex"].alias("c"))
    apart = _pairs(q, OWL + "disjointWith", "c", "d")
    found.append(types.join(apart, "c").join(types.select("s", F.col("c").alias("d")), ["s", "d"]).select(F.lit("cax-dw"), F.concat(text("s"), F.lit(" is in the disjoint classes "), F.least("c", "d"), F.lit(" and "), F.greatest("c", "d"))).distinct())
    ds, same = same_as(dataset), q.where(F.col("p") == OWL + "differentFrom").select("s", "o")
    left = same.join(ds.select(F.col("node").alias("s"), F.col("root").alias("x")), "s", "left").join(ds.select(F.col("node").alias("o"), F.col("root").alias("y")), "o", "left")
    found.append(left.where(F.coalesce("x", "s") == F.coalesce("y", "o")).select(F.lit("eq-diff"), F.concat(text("s"), F.lit(" and "), text("o"), F.lit(" are the same and different"))))
    return reduce(DataFrame.union, found).withColumn("severity", F.lit("Violation"))


def same_as(dataset: Dataset) -> DataFrame:
    """(node, root): owl:sameAs classes, named by their least member; labels spread until none changes."""
    e = dataset.quads.where(F.col("p") == OWL + "sameAs").select("s", "o")
    both = cut(e.union(e.select(F.col("o").alias("s"), F.col("s").alias("o"))).distinct())
    label = cut(both.select(F.col("s").alias("node")).distinct().withColumn("root", F.col("node")))
    while True:
        near = both.join(label, both["o"] == label["node"]).groupBy(F.col("s").alias("n")).agg(F.min("root").alias("low"))
        after = cut(label.join(near, F.col("node") == F.col("n"), "left").select("node", F.least("root", "low").alias("root")))
        if after.join(label, ["node", "root"], "left_anti").isEmpty():
            return after
        label = after


def with_same_as(dataset: Dataset) -> Dataset:
    """Quads fanned out over the sameAs classes of their subjects and objects, as every member stands for the others.

    The statements of sameAs stay as they are. A dataset without any comes back unchanged.
    """
    classes = same_as(dataset)
    if classes.isEmpty():
        return dataset
    pairs = classes.select(F.col("node").alias("x"), "root").join(classes.select(F.col("node").alias("y"), "root"), "root").select("x", "y")
    q = dataset.quads.select("g", "s", "p", "o")
    said, q = q.where(F.col("p") == OWL + "sameAs"), q.where(F.col("p") != OWL + "sameAs")
    q = q.join(pairs, q["s"] == pairs["x"], "left").select("g", F.coalesce("y", "s").alias("s"), "p", "o")
    q = q.join(pairs, q["o"] == pairs["x"], "left").select("g", "s", "p", F.coalesce("y", "o").alias("o"))
    return Dataset(cut(q.distinct().union(said)), dataset.graphs)
