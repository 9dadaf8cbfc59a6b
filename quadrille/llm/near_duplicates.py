"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Documents are sets of word shingles (SHINGLE words; a shorter text is one shingle). Equal sets are one class, found by
one combinable aggregate, and only its first document goes on. Each of TREES tries holds the documents by MAX_DEPTH
MinHash values: a node of a trie is a prefix, and the documents below it are those whose signatures, sorted, stand in a
row under that prefix. Matching starts at the longest prefixes. The pairs that meet there are verified exactly, and the
similarities of the links found tell how many more there should be: a link of similarity s meets at depth d in some tree
with probability 1 - (1 - s**d)**TREES. While the expected recall is below the target, all prefixes are shortened by one
value and the pairs that now meet for the first time are verified; the depth at which even a pair just at the threshold
meets with the target's probability ends it in any case. A corpus of close copies thus stops early, and one of links near
the threshold goes down to where these are found.

A node of up to NODE_ROWS documents gives its pairs. Larger nodes are groups of near copies: the nodes that share
documents are united, and the documents of each union are dealt into tiles of bounded size, whose pairs of tiles are
verified as matrix products. A tile gives one row per document (its number of links and a root), never one per pair.
No partner or candidate is capped.

Null, empty and blank texts have no shingles: each is a class of its own without links. Rows that repeat a doc_id and a
text are the same document twice and fall into one class. An empty table gives no rows. A null doc_id comes back as null.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import components, discard, give_back, materialise, take_over
from .text import chunks, mix, run_hashes, words

SHINGLE, THRESHOLD = 5, 0.8
TREES, MAX_DEPTH, RECALL = 40, 9, 0.9998
NODE_ROWS, TILE_ROWS = 64, 256
NO_ID = -(1 << 63)
U = "struct<id:long,th:long>"


def depth(threshold: float, trees: int = TREES, most: int = MAX_DEPTH, recall: float = RECALL) -> int:
    """The longest prefix at which a pair of this similarity meets in some tree with the wanted probability: prefixes are never shorter."""
    for k in range(most, 1, -1):
        if 1 - (1 - threshold**k) ** trees >= recall:
            return k
    return 1


def shingle_sets(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all documents in a row, and where each document's begin; a short document is one shingle."""
    n = np.diff(first)
    grams = run_hashes(hashes, k)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    begins = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(first[:-1] - begins[:-1], count) + np.arange(begins[-1])
    out = np.zeros(int(begins[-1]), np.uint64)
    long_ = np.repeat(n >= k, count)
    out[long_] = grams[at[long_]]
    for d in np.flatnonzero((n > 0) & (n < k)):
        h = np.uint64(int(n[d]))
        with np.errstate(over="ignore"):
            for x in hashes[first[d] : first[d + 1]]:
                h = mix(np.array([h ^ x], np.uint64))[0] * np.uint64(0x9E3779B97F4A7C15 | 1)
        out[begins[d]] = h
    return out, begins


@lru_cache(maxsize=4)
def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return seeds[:n] | np.uint64(1), seeds[n:]


#: Bits of each value beyond the shortest prefix; two values that share them only give one more candidate.
TAIL_BITS = 21


def signatures(grams: np.ndarray, begins: np.ndarray, trees: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Per tree and non-empty document: a hash of the first `least` MinHash values, and the values up to `most`, TAIL_BITS each."""
    a, b = _multipliers(trees * most)
    heads, tails = np.zeros((len(begins), trees), np.uint64), np.zeros((len(begins), trees), np.uint64)
    low = np.uint64((1 << TAIL_BITS) - 1)
    with np.errstate(over="ignore"):
        for t in range(trees):
            key = np.full(len(begins), t + 1, np.uint64)
            for j in range(most):
                value = np.minimum.reduceat(grams * a[t * most + j] + b[t * most + j], begins)
                if j < least:
                    key = mix(key ^ value) + np.uint64(j)
                else:
                    tails[:, t] = (tails[:, t] << np.uint64(TAIL_BITS)) | (mix(value) & low)
            heads[:, t] = key
    return heads, tails


def _profiles(docs: DataFrame, k: int, trees: int, least: int, most: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("near_duplicates")
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(2)):
                w = words(data, offsets)
                grams, begins = shingle_sets(w.hash, w.first, k)
                size = np.diff(begins)
                full = np.flatnonzero(size)
                keys, tails = np.zeros((b - a, trees), np.uint64), np.zeros((b - a, trees), np.uint64)
                # The set, not the bag: repeats within a document count once.
                owner = np.repeat(np.arange(b - a), size)
                order = np.lexsort((grams, owner))
                g, o = grams[order], owner[order]
                new = np.ones(len(g), bool)
                new[1:] = (g[1:] != g[:-1]) | (o[1:] != o[:-1])
                g, o = g[new], o[new]
                sets = np.zeros((b - a, 2), np.uint64)
                if len(full):
                    begins = np.searchsorted(o, full)
                    keys[full], tails[full] = signatures(g, begins, trees, least, most)
                    sets[full, 0], sets[full, 1] = np.add.reduceat(mix(g), begins), np.add.reduceat(mix(g ^ np.uint64(0x5851F42D4C957F2D)), begins)
                n = np.bincount(o, minlength=b - a)
                at = pa.array(np.concatenate([[0], np.cumsum(np.where(n > 0, trees, 0))]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, pa.array(x[n > 0].reshape(-1).view(np.int64))) for x in (keys, tails)]
                figures = [pa.array(n.astype(np.int64)), pa.array(sets[:, 0].view(np.int64)), pa.array(sets[:, 1].view(np.int64))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *figures, *lists], ["id", "th", "n", "set_a", "set_b", "keys", "tails"])
        give_back()

    return docs.mapInArrow(run, "id long, th long, n long, set_a long, set_b long, keys array<long>, tails array<long>")


def at_depth(signed: DataFrame, depth: int, least: int, most: int) -> DataFrame:
    """The nodes of all tries at this depth: one row (key, u) for each document below a node."""
    rows = signed.select("u", F.explode(F.arrays_zip("keys", "tails")).alias("x"))
    if depth == least:
        return rows.select(F.col("x.keys").alias("key"), "u")
    return rows.select(F.xxhash64("x.keys", F.shiftrightunsigned("x.tails", TAIL_BITS * (most - depth))).alias("key"), "u")


def expected_recall(links: DataFrame, depth: int, trees: int) -> float:
    """Links found, over those expected: each link found stands for 1 / (its chance to be found) links."""
    chance = 1 - F.pow(1 - F.pow(F.col("j"), depth), trees)
    found, expected = links.agg(F.count("*"), F.sum(1 / chance)).first()
    return found / expected if found else 0.0


def _set_of(text: str, k: int) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    w = words(raw, np.array([0, len(raw)]))
    return np.unique(shingle_sets(w.hash, w.first, k)[0])


def _verify(pairs: DataFrame, k: int, threshold: float) -> DataFrame:
    """pairs: x, y, x_text, y_text, those of one x in a row -> the pairs (x, y) that reach the threshold, and their similarity j."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("near_duplicates")
        last, own = None, np.zeros(0)
        for batch in batches:
            keep, similarity = np.zeros(batch.num_rows, bool), np.zeros(batch.num_rows)
            left, right = batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                if (x := left[i].as_py()) != last:
                    last, own = x, _set_of(x, k)
                other = _set_of(right[i].as_py(), k)
                both = len(np.intersect1d(own, other, assume_unique=True))
                keep[i] = both >= threshold * (len(own) + len(other) - both) - 1e-9
                similarity[i] = both / max(1, len(own) + len(other) - both)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask), pa.array(similarity[keep])], ["x", "y", "j"])
        give_back()

    return pairs.mapInArrow(run, f"x {U}, y {U}, j double")


def _tile(k: int, threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        take_over("near_duplicates")
        alone = not (pdf["side"] != 2).any()
        rows = pdf.drop_duplicates(["id", "th"]) if alone else pdf
        sets = [_set_of(t, k) for t in rows["text"]]
        flat = np.concatenate(sets)
        _, number = np.unique(flat, return_inverse=True)
        ends = np.cumsum([len(s) for s in sets])
        total = int(number.max()) + 1
        both = np.zeros((len(sets), len(sets)), np.float32)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        for c in range(0, total, 8192):
            pick = (number >= c) & (number < c + 8192)
            block = np.zeros((len(sets), min(8192, total - c)), np.float32)
            block[owner[pick], number[pick] - c] = 1
            both += block @ block.T
        size = np.diff(np.concatenate([[0], ends])).astype(np.float32)
        linked = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-6
        np.fill_diagonal(linked, False)
        if not alone:
            side = rows["side"].to_numpy()
            linked &= side[:, None] != side[None, :]
        root = np.arange(len(sets))
        while True:  # least label among neighbours until nothing changes
            low = np.minimum(root, np.where(linked, root[None, :], len(sets)).min(axis=1, initial=len(sets)))
            low = low[low]
            if (low == root).all():
                break
            root = low
        return pd.DataFrame({"id": rows["id"].to_numpy(), "th": rows["th"].to_numpy(), "links": linked.sum(axis=1).astype(np.int64), "r_id": rows["id"].to_numpy()[root], "r_th": rows["th"].to_numpy()[root]})

    return run


def classes(documents: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL, node_rows: int = NODE_ROWS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """One row per document: id and th (key and text hash), rep (first document of the same shingle set), root (first of
    its near-duplicate component), copies (documents of the same set) and links (other sets at or over the threshold)."""
    docs = documents.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(key, text).alias("th"), F.col(text).alias("text"))
    least = depth(threshold, trees, recall=recall)
    most = max(MAX_DEPTH, least)
    profile = materialise(_profiles(docs, shingle, trees, least, most), "near-profiles")
    sets = profile.where("n > 0").groupBy("set_a", "set_b").agg(F.min(F.struct("id", "th")).alias("rep"), F.count("*").alias("copies"))
    sets = materialise(sets, "near-sets")
    signed = materialise(profile.join(sets.select("rep.*"), ["id", "th"], "left_semi").select(F.struct("id", "th").alias("u"), "keys", "tails"), "near-signed")

    def texts_of(nodes: DataFrame) -> DataFrame:
        # Built on the side of the wanted keys: the texts move once and are not sorted.
        held = docs.join(nodes.select("u.*").distinct().hint("shuffle_hash"), ["id", "th"], "left_semi").dropDuplicates(["id", "th"])
        return materialise(held.select(F.struct("id", "th").alias("u"), "text"), "near-texts")

    # From the longest prefixes to shorter ones, until the links found tell that few are missing.
    verified = None
    for d in range(most, least - 1, -1):
        nodes = at_depth(signed, d, least, most)
        shared = materialise(nodes.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "near-nodes")
        members = materialise(nodes.join(shared, "key").select("key", "n", "u").distinct(), "near-members")
        small = members.where(F.col("n") <= node_rows).select("key", "u")
        pairs = small.select("key", F.col("u").alias("x")).join(small.select("key", F.col("u").alias("y")), "key").where("x < y").select("x", "y").distinct()
        pairs = materialise(pairs if verified is None else pairs.join(tried, ["x", "y"], "left_anti"), "near-pairs")
        tried = pairs if verified is None else tried.union(pairs)
        texts = texts_of(pairs.select(F.col("x").alias("u")).union(pairs.select(F.col("y").alias("u"))))
        with_x = pairs.join(texts.select(F.col("u").alias("x"), F.col("text").alias("x_text")), "x")
        with_y = with_x.join(texts.select(F.col("u").alias("y"), F.col("text").alias("y_text")), "y")
        new = materialise(_verify(with_y.select("x", "y", "x_text", "y_text").sortWithinPartitions("x"), shingle, threshold), "near-verified")
        verified = new if verified is None else verified.union(new)
        discard(texts, shared)
        if expected_recall(verified, d, trees) >= recall:
            break

    big = members.where(F.col("n") > node_rows)
    lows = big.groupBy("key").agg(F.min("u").alias("low"))
    groups = materialise(components(big.join(lows, "key").select(F.col("u").alias("a"), F.col("low").alias("b"))).select(F.col("node").alias("u"), F.col("root").alias("g")), "near-groups")
    # Links within a group are counted by its tiles.
    gx, gy = groups.select(F.col("u").alias("x"), F.col("g").alias("gx")), groups.select(F.col("u").alias("y"), F.col("g").alias("gy"))
    verified = verified.join(gx, "x", "left").join(gy, "y", "left").where("gx IS NULL OR gy IS NULL OR gx != gy").select("x", "y")
    verified = materialise(verified, "near-links")
    texts = texts_of(groups)

    sizes = materialise(groups.groupBy("g").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("b")), "near-sizes")
    dealt = groups.join(sizes, "g").join(texts, "u").withColumn("t", F.pmod(F.xxhash64("u"), F.col("b")).cast("int"))
    tiles = dealt.select("g", "u", "text", "t", F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("o"))
    tiles = tiles.select("g", F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"), F.when(F.col("t") == F.col("o"), 2).when(F.col("t") < F.col("o"), 0).otherwise(1).alias("side"), "u.*", "text")
    # Side 2 marks the documents of a tile that is paired with itself.
    matched = tiles.groupBy("g", "i", "j").applyInPandas(_tile(shingle, threshold), "id long, th long, links long, r_id long, r_th long")
    matched = materialise(matched, "near-tiles")
    u, r = F.struct("id", "th"), F.struct(F.col("r_id").alias("id"), F.col("r_th").alias("th"))
    links = verified.select(F.col("x").alias("u"), F.lit(1).cast("long").alias("links")).union(verified.select("y", F.lit(1).cast("long"))).union(matched.select(u, "links"))
    links = links.groupBy("u").agg(F.sum("links").alias("links"))
    roots = components(verified.select(F.col("x").alias("a"), F.col("y").alias("b")).union(matched.where("links > 0").select(u.alias("a"), r.alias("b"))))
    heads = sets.join(links, sets.rep == links.u, "left").drop("u").join(roots, sets.rep == roots.node, "left")
    heads = heads.select("set_a", "set_b", "rep", "copies", F.coalesce("links", F.lit(0)).cast("long").alias("links"), F.coalesce("root", "rep").alias("root"))
    heads = materialise(heads, "near-heads")
    own = F.struct("id", "th")
    return profile.select("id", "th", "n", "set_a", "set_b").join(heads, ["set_a", "set_b"], "left").select(
        "id", "th", F.when(F.col("n") > 0, F.col("rep")).otherwise(own).alias("rep"), F.when(F.col("n") > 0, F.col("root")).otherwise(own).alias("root"),
        F.when(F.col("n") > 0, F.col("copies")).otherwise(1).alias("copies"), F.when(F.col("n") > 0, F.col("links")).otherwise(0).alias("links"),
    )


def one_of_each(documents: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents without those of which a near duplicate stays: the first of each component, by key, stays once."""
    found = classes(documents, key=key, text=text, **options)
    first = found.where("root.id = id AND root.th = th").select(F.col("id").alias("_id"), F.col("th").alias("_th")).distinct()
    # Rows equal in key and text are one document, also where they have no shingles; of such rows the one of least hash stays.
    keyed = documents.withColumns({"_id": F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)), "_th": F.xxhash64(key, text)})
    kept = keyed.join(materialise(first, "near-first"), ["_id", "_th"])
    hashed = F.xxhash64(*(f"`{f.name}`" for f in documents.schema if "map<" not in f.dataType.simpleString()))
    return kept.groupBy("_id", "_th").agg(F.min_by(F.struct(*(f"`{c}`" for c in documents.columns)), hashed).alias("_row")).select("_row.*")
