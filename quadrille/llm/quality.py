"""Quality rules by weak supervision, in built-in functions only.

Rules look at one document each and vote good (1), bad (-1) or abstain (0). Expectation-maximisation finds how often
each rule is right for good and for bad documents without any labels, from the counts of the vote patterns: at most
3 ** rules rows, made by one combinable aggregate, whatever the size of the corpus. The posterior probability of good,
given a document's votes, then decides instead of a demand that all rules pass: a lone objection of a rule that other
rules seldom support is outvoted. All documents with words take part in learning, those that the base rule rejects too.

It starts from a vote in which one objection weighs as much as four approvals, as rules are made to object seldom, and
goes on until no probability moves by TOLERANCE, for ROUNDS rounds at most. A rule is taken to be no worse than chance: an
objection never speaks for a document, an approval never against it.

A null or empty text has no words: it fails the base rule. Ties at the threshold are kept. An empty table learns
nothing and gives no rows. Repeated rows are judged each on its own; columns named as the results are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import materialise

#: Fixed values of the base rule.
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: Words below which the length rule objects.
SHORT_WORDS = 20
ROUNDS, TOLERANCE = 200, 1e-7
#: Log odds that a vote adds at the start.
APPROVAL, OBJECTION = 0.5, 2.0
THRESHOLD = 0.5


#: Where a word ends in a letter or digit, with or without usual punctuation after it.
PLAIN = r"[\p{L}\p{N}][.,;:!?\"'»)\]]*(?=[\x20\x09-\x0D]|\z)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a lambda's argument is never expanded into its uses."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _blanks(text: Column) -> Column:
    """White space as blanks; replace() searches bytes and is far quicker than translate()."""
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def _words(text: Column) -> Column:
    return F.array_remove(F.split(_blanks(text), " "), "")


def _repeat_words(words: Column) -> Column:
    """Words in 5-word windows that the array holds twice or more."""

    def covered(grams: Column) -> Column:
        pairs = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def among(p: Column) -> Column:
            def twin(x: Column, k: Column) -> Column:
                left = F.when(k > 0, F.get(p, k - 1)["g"] == x["g"]).otherwise(False)
                return left | F.coalesce(F.get(p, k + 1)["g"] == x["g"], F.lit(False))

            found = F.array_sort(F.transform(F.filter(p, twin), lambda x: x["i"]))
            # Each repeated window covers the words up to the next one's start, five at most.
            return let(found, lambda s: F.aggregate(F.transform(s, lambda a, k: F.least(F.lit(5), F.coalesce(F.get(s, k + 1) - a, F.lit(5)))), F.lit(0), lambda t, c: t + c))

        return let(pairs, among)

    def of(w: Column) -> Column:
        grams = F.transform(F.slice(w, 1, F.size(w) - 4), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2), F.get(w, i + 3), F.get(w, i + 4)))
        return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(covered(g)))

    return let(F.transform(words, lambda x: F.xxhash64(x)), lambda w: F.when(F.size(w) < 6, 0).otherwise(of(w)))


def signals(text: Column) -> dict[str, Column]:
    """Per-document figures; characters are code points, words are runs outside [\\x20\\x09-\\x0D]."""
    t = F.coalesce(text, F.lit(""))
    words = _words(t)
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = let(words, lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("c"), _repeat_words(w).alias("r")))
    return {
        "_q": counts,
        "n_words": F.col("_q.n").cast("long"),
        "word_chars": F.col("_q.c").cast("long"),
        "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_upper": F.regexp_count(t, F.lit("[A-Z]")).cast("long"),
        "n_cries": F.regexp_count(t, F.lit("[!?]")).cast("long"),
        "n_plain": F.regexp_count(t, F.lit(PLAIN)).cast("long"),
        "n_repeat_words": F.col("_q.r").cast("long"),
    }


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """The rules' votes over the figures of signals()."""
    n, chars = F.col("n_words"), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "length": _vote(n >= 50, n < SHORT_WORDS),
        "word_length": _vote(F.col("word_chars").between(3 * n, 10 * n), (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 16 * n)),
        "symbols": _vote(200 * F.col("n_symbols") <= chars, 100 * F.col("n_symbols") > 4 * chars),
        "plain_words": _vote(100 * F.col("n_plain") >= 90 * n, 100 * F.col("n_plain") < 70 * n),
        "repeated_lines": _vote(F.col("n_dup_lines") == 0, 10 * F.col("n_dup_lines") > 5 * F.col("n_lines")),
        "repeated_words": _vote(100 * F.col("n_repeat_words") <= 5 * n, 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n),
        "capitals": _vote(100 * F.col("n_upper") <= 15 * chars, 100 * F.col("n_upper") > 30 * chars),
        "exclamations": _vote(100 * F.col("n_cries") <= 2 * n, 100 * F.col("n_cries") > 40 * n),
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def measured(documents: DataFrame, text: str = "text") -> DataFrame:
    figures = signals(F.col(text))
    out = documents.drop(*figures).withColumn("_q", figures.pop("_q"))
    return out.withColumns(figures).drop("_q")


def learn(votes: DataFrame, names: list[str], rounds: int = ROUNDS) -> dict[str, float | list[float]]:
    """EM over the vote patterns: the share of good documents, and per rule the logarithms of P(vote | good) and P(vote | bad).

    The probabilities are of the votes -1 and 1 among documents on which the rule doesn't abstain: abstaining tells nothing.
    All rounds run inside one expression over the array of patterns (at most 3 ** rules of them). Add-one smoothing keeps
    every probability positive. `moved` is the last round's greatest change. Entries for vote 0 are unused.
    """
    patterns = votes.groupBy(*names).agg(F.count("*").cast("double").alias("n"))
    packed = patterns.agg(F.collect_list(F.struct(F.array(*(F.col(c).cast("int") for c in names)).alias("v"), "n")).alias("rows"))
    m = len(names)
    many = lambda xs: F.aggregate(xs, F.lit(0.0), lambda t, x: t + x)
    # Entry i of a parameter array is of rule i / 3 and vote i % 3 - 1. All is folded over arrays, which keeps the plan small.
    entries, each_rule = F.sequence(F.lit(0), F.lit(3 * m - 1)), F.sequence(F.lit(0), F.lit(m - 1))

    def maximise(weighed: Column) -> Column:
        """weighed: rows of (v, n, p = posterior of good) -> parameters."""

        def shares(weight) -> Column:
            def entry(i: Column) -> Column:
                rule, vote = (i / 3).cast("int"), i % 3 - 1
                part = F.aggregate(weighed, F.lit(0.0), lambda t, r: t + F.when(F.get(r["v"], rule) == vote, weight(r)).otherwise(0.0))
                votes = F.aggregate(weighed, F.lit(0.0), lambda t, r: t + F.when(F.get(r["v"], rule) != 0, weight(r)).otherwise(0.0))
                return F.log((part + 1) / (votes + 2))

            return F.transform(entries, entry)

        good = F.aggregate(weighed, F.lit(0.0), lambda t, r: t + r["n"] * r["p"])
        all_ = F.aggregate(weighed, F.lit(0.0), lambda t, r: t + r["n"])
        return F.struct(((good + 1) / (all_ + 2)).alias("prior"), shares(lambda r: r["n"] * r["p"]).alias("good"), shares(lambda r: r["n"] * (1 - r["p"])).alias("bad"))

    def expect(rows: Column, p: Column) -> Column:
        def posterior(r: Column) -> Column:
            def add(odds: Column, j: Column) -> Column:
                vote = F.get(r["v"], j)
                worth = F.get(p["good"], vote + 3 * j + 1) - F.get(p["bad"], vote + 3 * j + 1)
                return odds + F.when(vote == -1, F.least(worth, F.lit(0.0))).when(vote == 1, F.greatest(worth, F.lit(0.0))).otherwise(0.0)

            odds = F.aggregate(each_rule, F.log(p["prior"] / (1 - p["prior"])), add)
            return 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), odds))))

        return F.transform(rows, lambda r: F.struct(r["v"].alias("v"), r["n"].alias("n"), posterior(r).alias("p")))

    def start(v: Column) -> Column:
        odds = many(F.transform(v, lambda x: F.when(x == 1, APPROVAL).when(x == -1, -OBJECTION).otherwise(0.0)))
        return 1 / (1 + F.exp(-odds))

    def moved(p: Column, q: Column) -> Column:
        far = F.zip_with(F.concat(p["good"], p["bad"]), F.concat(q["good"], q["bad"]), lambda x, y: F.abs(F.exp(x) - F.exp(y)))
        return F.greatest(F.array_max(far), F.abs(p["prior"] - q["prior"]))

    def step(p: Column) -> Column:
        return let(let(expect(F.col("rows"), p), maximise), lambda q: q.withField("moved", moved(p, q)))

    first = F.transform(F.col("rows"), lambda r: F.struct(r["v"].alias("v"), r["n"].alias("n"), start(r["v"]).alias("p")))
    fitted = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), maximise(first).withField("moved", F.lit(1.0)), lambda p, _: F.when(p["moved"] < TOLERANCE, p).otherwise(step(p)))
    row = packed.select(fitted.alias("p")).first()
    return row["p"].asDict()


def posterior(parameters: Mapping, names: list[str]) -> Column:
    import math

    prior = parameters["prior"]
    total = F.lit(math.log(prior / (1 - prior)))
    for j, c in enumerate(names):
        odds = [parameters["good"][3 * j + x + 1] - parameters["bad"][3 * j + x + 1] for x in (-1, 0, 1)]
        total = total + F.when(F.col(c) == -1, min(0.0, odds[0])).when(F.col(c) == 1, max(0.0, odds[2])).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def judged(documents: DataFrame, *, text: str = "text", threshold: float = THRESHOLD, keep_text: bool = True) -> DataFrame:
    """The documents with their figures, votes (columns vote_*), quality (posterior of good), base_failed and kept.

    The figures are computed once, in one pass, and written to the shared folder; learning and judging read them there.
    """
    votes = {f"vote_{k}": v for k, v in rules().items()}
    documents = documents.drop(*votes, "quality", "base_failed", "kept")
    figures = measured(documents, text)
    figures = materialise((figures if keep_text else figures.drop(text)).withColumns(votes), "quality")
    names = list(votes)
    p = posterior(learn(figures.where("n_words > 0"), names), names)
    out = figures.withColumns({"quality": p, "base_failed": base_failed()})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
