"""Fuzzy line dedup by MinHash, in built-in functions only.

Lines are cut at \\n; lines without a visible character are never touched. A line's shingles are its runs of SHINGLE
characters. Where words are many, its signature is made of one run for each word, from its beginning (SHINGLE characters
of it at most) to the end of the next: a choice by content that is alike in both lines of a pair; where words are few or
long, of all shingles. They are hashed once and sorted once. The MinHash orders are BANDS rotations
of the circle of hashes: the band of a rotation holds the ROWS least shingles from that rotation's point on, found by
place in the one sorted array. Lines near the border between the two kinds of signature have both. Lines that share a
band are candidates, exact Jaccard on all shingles verifies them, and distributed union-find joins what is verified. Of each component one line stays: the one that comes first by document and
line number, in its first place only.

A bucket of up to NODE_ROWS distinct lines gives its pairs. Larger buckets that share lines are united into groups. Their
lines meet one line of each bucket; what that leaves outside a group's largest component meets all lines of the group that
can reach the threshold with it, found by an exact prefix filter. Every pair of a bucket that reaches the threshold is thus
verified, or joined by others: nothing is capped or dropped. Pairs that share no bucket are no candidates and are passed over.

Null and empty texts have no lines. A line shorter than a shingle equals only its like. Rows that repeat both key and text
are one document and get one and the same result; documents that share or lack a key and differ in text are ordered by
their text. An empty table gives no rows. Columns that bear the names of the results are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import let
from .runtime import components, discard, materialise

SHINGLE, THRESHOLD = 8, 0.8
BANDS, ROWS = 12, 4
VISIBLE = r"[^\x20\x09-\x0D]"
#: Words, and characters to each, at the two ends of the border between the kinds of signature.
FEW, SPARSE = (8, 14), (14, 24)
NODE_ROWS = 32
#: Lines of a group, about, that tell which of its shingles are common. The choice changes the work, not the result.
SAMPLE_LINES = 32
#: Rows beyond which a line's copies are left out before keys are dealt out.
COMMON_ROWS = 1000
#: 64-bit words of a line's bitmap, and tokens before a shared one that are looked at. These, too, change only the work.
BITMAP, BEFORE = 8, 8


def _runs(line: Column, by=F.xxhash64) -> Column:
    """Hashes of the runs of SHINGLE characters; a shorter line is its own.

    As UTF-32 every character takes four bytes, so a run is cut out by its place and not by counting characters.
    """
    width = 4 * SHINGLE

    def runs(raw: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(raw) - (width - 1)), F.lit(4))
        return F.transform(starts, lambda i: by(F.call_function("substring", raw, i, F.lit(width))))

    return let(F.encode(line, "UTF-32"), runs)


def shingles(line: Column, by=F.xxhash64) -> Column:
    return F.array_distinct(_runs(line, by))


def _signed(x: int) -> int:
    return x - ((x >> 63) << 64)


def with_bands(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds kind and keys (one per band) in one row for each kind of signature that a line has.

    A signature of words needs FEW of them, one in SPARSE characters at least. Steps are columns of their own, which keeps
    them in generated code. Rows are doubled before the signatures are made, as those are far larger than a line's kinds.
    """
    x = lines.withColumns({"_m": F.octet_length(line) - F.octet_length(F.replace(F.col(line), F.lit(" "), F.lit(""))) + 1, "_n": F.length(line)})
    m, size = F.col("_m"), F.col("_n")
    many, few = (m >= FEW[0]) & (m * SPARSE[1] >= size), (m < FEW[1]) | (m * SPARSE[0] < size)
    kinds = F.when(many & few, F.array(F.lit(0), F.lit(1))).when(many, F.array(F.lit(0))).when(few, F.array(F.lit(1)))
    # Words are cut and hashed within one expression: as a column they would be copied from step to step.
    words = let(F.split(F.col(line), " "), lambda ws: F.transform(ws, lambda w, i: F.xxhash64(F.left(w, F.lit(SHINGLE)), F.get(ws, i + 1))))
    x = x.withColumn("kind", F.explode(kinds)).withColumn("_r", F.when(F.col("kind") == 0, words).otherwise(_runs(F.col(line)))).drop("_m", "_n")
    x = x.withColumn("_r", F.sort_array(F.array_distinct("_r")))
    marks = [_signed(((2 * j + 1) << 63) // BANDS) for j in range(BANDS)]
    marks.sort()
    # Among the sorted hashes and points, a point's place tells how many hashes are less than it.
    x = x.withColumns({"_s": F.sort_array(F.concat("_r", F.array(*map(F.lit, marks)))), "_w": F.concat("_r", F.slice("_r", 1, ROWS)), "_n": F.size("_r")})

    def band(j: int, m: int) -> Column:
        at = F.pmod(F.array_position("_s", F.lit(m)).cast("int") - (j + 1), F.col("_n"))
        return F.xxhash64(F.lit(j), F.slice("_w", at + 1, F.lit(ROWS)))

    return x.withColumn("keys", F.array(*(band(j, m) for j, m in enumerate(marks)))).drop("_r", "_s", "_w", "_n")


def _could(a: Column, b: Column, threshold: float) -> Column:
    """May sets of these sizes reach the threshold?"""
    return F.least(a, b) >= threshold * F.greatest(a, b) - 1e-9


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """pairs (x, y) of line hashes -> edges (a, b) of lines that reach the threshold."""
    sizes = texts.select("a", "n")
    pairs = pairs.join(sizes.select(F.col("a").alias("x"), F.col("n").alias("xn")), "x").join(sizes.select(F.col("a").alias("y"), F.col("n").alias("yn")), "y")
    pairs = materialise(pairs.where(_could(F.col("xn"), F.col("yn"), threshold)).select("x", "y").distinct(), "line-close")
    both = pairs.join(texts.select(F.col("a").alias("x"), F.col("u").alias("a"), F.col("n").alias("xn"), F.col("line").alias("_x")), "x")
    both = both.join(texts.select(F.col("a").alias("y"), F.col("u").alias("b"), F.col("n").alias("yn"), F.col("line").alias("_y")), "y")
    sets = both.select("a", "b", "xn", "yn", _runs(F.col("_x")).alias("_x"), _runs(F.col("_y")).alias("_y"))
    sets = sets.withColumn("_n", F.size(F.array_intersect("_x", "_y")))
    return sets.where(F.col("_n") >= threshold * (F.col("xn") + F.col("yn") - F.col("_n")) - 1e-9).select("a", "b")


def _bitmaps(sets: DataFrame) -> DataFrame:
    """sets: lines (g, a) and their shingles s -> a bitmap m0, m1 ... each: a bit is the parity of the shingles that fall on it."""
    # Dealt out line by line: a large group's lines lie in few files.
    t = sets.select("g", "a", "s").repartition("g", "a").select("g", "a", F.explode("s").alias("t"))
    word, bit = F.pmod(F.shiftright("t", 6), F.lit(BITMAP)), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("t").bitwiseAND(63).cast("int"))
    return t.groupBy("g", "a").agg(*(F.coalesce(F.bit_xor(F.when(word == j, bit)), F.lit(0).cast("long")).alias(f"m{j}") for j in range(BITMAP)))


def _linked(dealt: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """dealt: lines (g, u, c, line) of groups g, joined as far as c says -> edges (a, b) of all pairs of a group that reach the threshold and lie in two c, one of them outside the largest.

    Pairs are found by their prefixes. Let all lines of a group order their shingles alike: two lines that reach the threshold have
    so many in common that the first of these stands early in both, so only lines that share an early shingle are verified.
    Whichever the order, no pair is lost; shingles that a sample of the group shares are put last, so that lines which
    have much of their own begin with it and meet nobody. Of lines that meet, those whose bitmaps tell that too many shingles
    differ are not verified.
    """
    parts = materialise(dealt.groupBy("g", "c").agg(F.count("*").alias("n")), "line-parts")
    whole = parts.groupBy("g").agg(F.max(F.struct("n", "c")).alias("top"), F.sum("n").alias("all")).where("top.n < all").select("g", F.col("top.c").alias("top"), "all")
    open_ = dealt.join(materialise(whole, "line-open"), "g")
    sampled = F.pmod(F.xxhash64("u"), F.ceil(F.col("all") / SAMPLE_LINES)) == 0
    # From here on a group is its hash: were two to share one, their lines would meet in vain.
    sets = open_.select(F.xxhash64("g").alias("g"), F.col("u.a").alias("a"), F.col("c.a").alias("c"), (F.col("c") == F.col("top")).alias("main"), sampled.alias("sampled"), shingles(F.col("line")).alias("s"))
    sets = materialise(sets, "line-sets")
    common = sets.where("sampled").select("g", F.explode("s").alias("t")).groupBy("g", "t").agg(F.count("*").alias("n")).where("n > 1")
    common = materialise(common.groupBy("g").agg(F.collect_list("t").alias("often")), "line-common")
    x = sets.join(common, "g", "left").withColumn("often", F.coalesce("often", F.array().cast("array<bigint>")))
    x = x.withColumn("s", F.concat(F.sort_array(F.array_except("s", "often")), F.sort_array(F.array_intersect("s", "often")))).withColumn("n", F.size("s"))
    x = materialise(x.select("g", "a", "c", "main", "s", "n"), "line-sorted")
    x = x.repartition("g", "a").join(_bitmaps(sets), ["g", "a"])
    early = F.slice("s", F.lit(1), (F.col("n") - F.ceil(threshold * F.col("n") - 1e-9) + 1).cast("int"))
    x = x.withColumn("early", F.transform(early, lambda t, i: F.struct(i.alias("at"), t.alias("t"), F.slice("s", F.greatest(F.lit(1), i + 1 - BEFORE), F.least(i, F.lit(BEFORE))).alias("before"))))
    x = x.select("g", "a", "c", "main", "n", *(f"m{j}" for j in range(BITMAP)), F.inline("early"))
    x = materialise(x, "line-prefixes")
    p, q = x.where("NOT main").alias("p"), x.alias("q")
    # Of a pair's shared shingles, the first leaves no more to share than what stands from it on. The others need not lead to
    # the pair: all but few of them are known by a shared one shortly before.
    left = F.least(F.col("p.n") - F.col("p.at"), F.col("q.n") - F.col("q.at"))
    enough = left * (1 + threshold) >= threshold * (F.col("p.n") + F.col("q.n")) - 1e-6
    leads = ~F.arrays_overlap("p.before", "q.before")
    # Bits that differ are no more than shingles that do.
    apart = reduce(lambda m, n: m + n, (F.bit_count(F.col(f"p.m{j}").bitwiseXOR(F.col(f"q.m{j}"))) for j in range(BITMAP)))
    near = apart * (1 + threshold) <= (1 - threshold) * (F.col("p.n") + F.col("q.n")) + 1e-6
    pairs = p.join(q, (F.col("p.g") == F.col("q.g")) & (F.col("p.t") == F.col("q.t")) & (F.col("p.c") != F.col("q.c")) & (F.col("q.main") | (F.col("p.a") < F.col("q.a"))) & enough & near & leads)
    pairs = materialise(pairs.select(F.col("p.a").alias("x"), F.col("q.a").alias("y")).distinct(), "line-met")
    return materialise(_verified(pairs, texts, threshold), "line-links")


def _lines(documents: DataFrame, key: str, text: str) -> DataFrame:
    # The text is hashed once, not for each of its lines.
    rows = documents.select(F.col(key).cast("long").alias("id"), F.xxhash64(key, text).alias("th"), F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1).alias("line"))
    rows = rows.select("id", "th", F.posexplode("line").alias("at", "line"))
    rows = rows.where(F.col("line").rlike(VISIBLE))
    return rows.withColumns({"a": F.xxhash64("line"), "b": F.xxhash64(F.lit(1), "line")})


def _among(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose a is one of `wanted`, and about an eighth of the others: a broadcast bitmap of the hashes, about one word to
    eight of them, keeps most texts from being dealt out."""
    at, bit = F.pmod(F.shiftright("a", 6), F.lit(max(1, wanted.count() // 8))), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("a").bitwiseAND(63).cast("int"))
    bits = wanted.groupBy(at.alias("_at")).agg(F.bit_or(bit).alias("_bits"))
    return rows.join(F.broadcast(bits), at == F.col("_at")).where(F.col("_bits").bitwiseAND(bit) != 0).drop("_at", "_bits")


def line_classes(documents: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All lines (id, th, at, a, b; some twice), the distinct ones: a, b (hashes), first (where it stands first: id, th, at),
    n (how often), and those that another line stands for: a, b, root (a, b and first place of that line).
    """
    rows = _lines(documents, key, text)
    signed = materialise(with_bands(rows).select("id", "th", "at", "a", "b", "kind", "keys"), "line-rows")
    # A line with signatures of both kinds has two rows.
    n = F.greatest(*(F.count_if(F.col("kind") == k) for k in (0, 1)))
    lines = materialise(signed.groupBy("a", "b").agg(F.min(F.struct("id", "th", "at")).alias("first"), n.alias("n")), "line-distinct")
    # A line of very many copies gives its keys where it stands first.
    often = lines.where(F.col("n") > COMMON_ROWS).select("a", "b", "first")
    once = signed.join(F.broadcast(often), ["a", "b"], "left").where(F.col("first").isNull() | F.struct("id", "th", "at").eqNullSafe(F.col("first")))
    # The keys are dealt out once, and read twice.
    keys = once.select("a", F.explode("keys").alias("k")).repartition("k")
    # A bucket of more than one line has a least and a greatest hash; equal lines share theirs.
    shared = keys.groupBy("k").agg(F.min("a").alias("low"), F.max("a").alias("high")).where("low != high").select("k", "low")
    members = materialise(keys.join(shared.hint("shuffle_hash"), "k").select("k", "low", "a").distinct(), "line-members")
    # The signatures have done their work; the lines' places stay.
    places = materialise(signed.select("id", "th", "at", "a", "b"), "line-places")
    discard(signed)
    sizes = materialise(members.groupBy("k").agg(F.count("*").alias("m")).where(F.col("m") > NODE_ROWS).select("k"), "line-buckets")
    large = not sizes.isEmpty()
    small = members.join(sizes, "k", "left_anti") if large else members
    x, y = small.select("k", F.col("a").alias("x")), small.select("k", F.col("a").alias("y"))
    pairs = x.join(y, "k").where("x < y").select("x", "y")
    if large:
        big = materialise(members.join(sizes, "k").select("k", "low", "a"), "line-big")
        pairs = pairs.union(big.where("low != a").select(F.col("low").alias("x"), F.col("a").alias("y")))
    pairs = materialise(pairs.distinct(), "line-pairs")
    discard(members)
    wanted = pairs.select(F.col("x").alias("a")).union(pairs.select(F.col("y").alias("a"))).distinct()
    # A line's text is taken where it stands first; a repeated document has that place twice. Components are made of numbers, which
    # are joined and grouped far faster than places.
    named = materialise(lines.join(wanted, "a", "left_semi").select("a", "b", "first", F.monotonically_increasing_id().alias("u")), "line-named")
    texts = _among(rows, named).join(named, ["a", "b"]).where(F.struct("id", "th", "at").eqNullSafe(F.col("first"))).select("a", "u", "line")
    texts = materialise(texts.dropDuplicates(["u"]).withColumn("n", F.size(shingles(F.col("line")))), "line-texts")
    near = components(materialise(_verified(pairs, texts, threshold), "line-edges"))
    if large:
        near = materialise(near, "line-near")
        nodes = texts.select("a", "u")
        both = big.select("low", "a").distinct().join(nodes, "a").join(nodes.select(F.col("a").alias("low"), F.col("u").alias("l")), "low")
        groups = components(both.select(F.col("u").alias("a"), F.col("l").alias("b"))).select(F.col("node").alias("u"), F.col("root").alias("g"))
        dealt = groups.join(near, F.col("u") == F.col("node"), "left").select("g", "u", F.coalesce("root", "u").alias("c")).join(texts.select("u", "line"), "u")
        numbered = [x.withColumns({c: F.struct(F.col(c).alias("a")) for c in x.columns if c in ("u", "c")}) for x in (dealt, texts.withColumn("a", F.col("u")))]
        links = _linked(materialise(numbered[0], "line-groups"), numbered[1], threshold)
        near = components(near.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links.select("a.a", "b.a")))
        discard(big)
    near = materialise(near.join(named, F.col("node") == F.col("u")).select(F.col("root").alias("r"), F.struct("first", "a", "b").alias("own")), "line-joined")
    roots = near.join(near.groupBy("r").agg(F.min("own").alias("root")), "r").where("own != root").select("own.a", "own.b", "root")
    roots = materialise(roots, "line-roots")
    discard(texts, pairs)
    return places, lines, roots


def _gone(documents: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    """The documents that lose lines: id and th (key and text hash) and the numbers of those that go."""
    rows, lines, roots = line_classes(documents, key=key, text=text, threshold=threshold)
    # Lines of one place that no other stands for stay, and most are such: only the others are dealt out.
    again = lines.where("n > 1").join(roots, ["a", "b"], "left_anti").select("a", "b", "first")
    goes = materialise(again.unionByName(roots.select("a", "b"), allowMissingColumns=True), "line-goes")
    marked = _among(rows, goes).join(goes, ["a", "b"]).where(F.col("first").isNull() | ~F.struct("id", "th", "at").eqNullSafe(F.col("first")))
    return marked.groupBy("id", "th").agg(F.collect_set("at").alias("gone"))


def _n_lines(text: str) -> Column:
    return F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda x: x.rlike(VISIBLE)))


def without_fuzzy_lines(documents: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id and th (key and text hash), n_lines with a visible character, and the numbers of those that go."""
    gone = _gone(documents, key, text, threshold)
    docs = documents.select(F.col(key).cast("long").alias("id"), F.xxhash64(key, text).alias("th"), _n_lines(text).alias("n_lines")).where("n_lines > 0").dropDuplicates(["id", "th"])
    gone = gone.select(F.col("id").alias("_gid"), F.col("th").alias("_gth"), "gone")
    return docs.join(gone, F.col("id").eqNullSafe(F.col("_gid")) & (F.col("th") == F.col("_gth")), "left").select("id", "th", "n_lines", F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))


def deduplicated(documents: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, keep_text: bool = True) -> DataFrame:
    """The documents with n_lines, n_removed and, if wanted, the kept text; lines without a visible character stay."""
    docs = documents.drop("n_lines", "n_removed", "kept_text").withColumn("_th", F.xxhash64(key, text))
    gone = materialise(_gone(documents, key, text, threshold), "line-gone").select(F.col("id").alias("_gid"), F.col("th").alias("_gth"), F.col("gone").alias("_gone"))
    docs = docs.withColumn("_n", _n_lines(text))
    base = docs if keep_text else docs.drop(text)
    out = base.join(gone, F.col(key).cast("long").eqNullSafe(F.col("_gid")) & (F.col("_th") == F.col("_gth")), "left")
    out = out.withColumns({"n_lines": F.col("_n").cast("long"), "n_removed": F.coalesce(F.size("_gone"), F.lit(0)).cast("long")})
    if keep_text:
        kept = F.filter(F.split(F.col(text), "\n", -1), lambda x, i: F.coalesce(~F.array_contains("_gone", i), F.lit(True)))
        out = out.withColumn("kept_text", F.array_join(kept, "\n"))
    return out.drop("_gid", "_gth", "_th", "_n", "_gone")
