"""Substring dedup by relative Lempel-Ziv parsing over an index of reference blocks.

The reference is the corpus itself, in blocks: the words that one task of the indexing pass reads are a block, and a word's
place in it is its position. The index leads from a run of words to the first and the last place where it stands. As only
factors of at least a window (`window` words) matter, it holds no shorter runs: the anchor of a window is the run of ANCHOR
words with the least hash in it, so equal windows share their anchor, and the windows of one document that follow each
other under one anchor are a phrase. Phrases are indexed whole; where an anchor heads several different phrases, their
windows are indexed one by one, as factors may begin or end within these.

Parsing walks each document greedily, from left to right. A factor starts at the first window that the index finds in
another place and is extended word by word as long as the next window is found at the next position of the same block;
where it is not, the factor ends, and at this border the index is asked again, so that a factor from another place may
start within the window. A factor is (first word, end, block, position); the words of all factors are the duplicate
spans. Windows are judged on the input and not on what is left of it. Runs are compared by two 64-bit hashes, of the
anchor and of the whole.

However many documents share a passage, no task gathers its copies: the index combines counts and places before each
shuffle, and joins back to the documents have plain scans on both sides, which adaptive execution splits.

Nulls and texts shorter than a window keep all their words; a null text has none. Rows that repeat each other, or share
or lack a doc_id, are documents of their own and count as occurrences. An empty table gives no rows. Columns that bear the
names of the results are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import discard, give_back, materialise, take_over
from .text import Words, chunks, mix, run_hashes, span_hashes, words

WINDOW, ANCHOR = 35, 8
_PHRASE_BASE, _WINDOW_BASE = 0xA0761D6478BD642F, 0xE7037ED1A0B428DB
#: Low bits of a packed anchor hash that hold the place of the run; more words than that are taken in steps.
_PLACE_BITS = 22
#: Low bits of a place that hold the position in its block.
_POSITION_BITS = 40


def _places(grams: np.ndarray, span: int) -> np.ndarray:
    """Where the least run of each `span` consecutive ones stands."""
    low = np.uint64((1 << _PLACE_BITS) - 1)
    out = np.empty(max(0, len(grams) - span + 1), np.int64)
    take = max(1, int(low) - span + 1)
    for at in range(0, len(out), take):
        part = grams[at : at + take + span - 1]
        least, width = (part & ~low) | np.arange(len(part), dtype=np.uint64), 1
        while width < span:
            step = min(width, span - width)
            least = np.minimum(least[: len(least) - step], least[step:])
            width += step
        out[at : at + take] = (least & low).astype(np.int64) + at
    return out


def phrases(w: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of a chunk: document, first window (by its first word), number of windows, anchor and content hash."""
    n_words = len(w.hash)
    if n_words < window:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    owner = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    grams = run_hashes(w.hash, ANCHOR)
    n = n_words - window + 1
    place = _places(grams, window - ANCHOR + 1)
    inside = owner[:n] == owner[window - 1 :]
    starts = np.empty(n, bool)
    starts[0] = True
    starts[1:] = (place[1:] != place[:-1]) | (owner[1:n] != owner[: n - 1]) | (inside[1:] != inside[:-1])
    begin = np.flatnonzero(starts)
    size = np.diff(np.append(begin, n))
    held = inside[begin]
    begin, size = begin[held], size[held]
    anchor = grams[place[begin]]
    content = mix(span_hashes(w.hash, begin, begin + size + window - 1, _PHRASE_BASE) + size.astype(np.uint64))
    return owner[begin], begin, size, anchor, content


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _positions(documents: DataFrame, window: int) -> DataFrame:
    """One row per phrase: the document's key, the number of the phrase in it, its place, anchor and content."""
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("substring")
        place = TaskContext.get().partitionId() << _POSITION_BITS
        for batch in batches:
            ids, hashes = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for a, b, data, offsets in chunks(batch.column(2)):
                w = words(data, offsets)
                doc, begin, _, anchor, content = phrases(w, window)
                if len(doc):
                    first = np.searchsorted(doc, np.arange(b - a))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a:b][doc]), pa.array(hashes[a:b][doc]), pa.array((np.arange(len(doc)) - first[doc]).astype(np.int32)), pa.array(begin + place), _signed(anchor), _signed(content)], ["id", "th", "k", "at", "anchor", "content"])
                place += len(w.hash)
        give_back()

    return documents.mapInArrow(run, "id long, th long, k int, at long, anchor long, content long")


def _elsewhere(at: str) -> Column:
    """The first place where a run stands, or the last if the first is its own."""
    return F.when(F.col(at) == F.col("low"), F.col("high")).otherwise(F.col("low"))


def _marks(phrase: DataFrame) -> DataFrame:
    """Per document: (number, place elsewhere) of its phrases found whole, and (number, own place) of those whose windows
    must be looked up.

    A phrase of an anchor with several phrases is looked up once, where it stands first, for all that equal it.
    """
    whole = phrase.groupBy("anchor", "content").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    whole = materialise(whole, "rlz-phrases")
    several = materialise(whole.groupBy("anchor").agg(F.count("*").alias("m")).where("m > 1").select("anchor", F.lit(True).alias("several")), "rlz-anchors")
    wanted = whole.join(several, "anchor", "left").where("low != high OR several")
    wanted = materialise(wanted.select("anchor", "content", "low", "high", F.coalesce("several", F.lit(False)).alias("several")), "rlz-wanted")
    discard(whole, several)
    found, lookup = F.col("low") != F.col("high"), F.col("several") & (F.col("at") == F.col("low"))
    marks = phrase.join(wanted, ["anchor", "content"]).select("id", "th", "k", F.when(found, _elsewhere("at")).alias("found"), F.when(lookup, F.col("at")).alias("own"))
    marks = marks.where("found IS NOT NULL OR own IS NOT NULL")
    marks = marks.groupBy("id", "th").agg(F.collect_set(F.when(F.col("found").isNotNull(), F.struct("k", F.col("found").alias("at")))).alias("found"), F.collect_set(F.when(F.col("own").isNotNull(), F.struct("k", F.col("own").alias("at")))).alias("lookup"))
    marks = materialise(marks, "rlz-marks")
    discard(wanted, phrase)
    return marks


def _parse(raw: bytes, w_start: np.ndarray, w_end: np.ndarray, places: np.ndarray, window: int) -> tuple[int, list[tuple[int, int]], list[tuple[int, int, int]], bytes]:
    """places: for each window, where else the index finds it, or -1 -> words removed, spans, factors (start, end, place), kept words."""
    held = places >= 0
    starts, ends = held.copy(), held.copy()
    # A factor goes on where the next window stands at the next position.
    follows = held[1:] & held[:-1] & (places[1:] == places[:-1] + 1)
    starts[1:] &= ~follows
    ends[:-1] &= ~follows
    first = np.flatnonzero(starts)
    factors = list(zip(first.tolist(), (np.flatnonzero(ends) + window).tolist(), places[first].tolist(), strict=True))
    spans: list[tuple[int, int]] = []
    for a, b, _ in factors:
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], b)
        else:
            spans.append((a, b))
    kept, at = [], 0
    for a, b in [*spans, (len(w_start), len(w_start))]:
        if a > at:
            kept += raw[w_start[at] : w_end[a - 1]].split()
        at = b
    return sum(b - a for a, b in spans), spans, factors, b" ".join(kept)


_RESULT = [("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("factors", pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "end", "block", "position")])))]
_RESULT_SQL = "n_words long, n_removed long, kept_text string, kept_sha256 string, spans array<struct<start:long,end:long>>, factors array<struct<start:long,end:long,block:long,position:long>>"


def without_repeats(documents: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = WINDOW, keep_text: bool = True) -> DataFrame:
    """The documents with n_words, n_removed, kept_text, kept_sha256 (of the kept words joined by one blank), spans, factors.

    spans are ranges of word numbers, end excluded, and factors such ranges with the block and position of the same words
    elsewhere. keep_text=False leaves out the text and the kept text.
    """
    documents = documents.drop("n_words", "n_removed", "kept_text", "kept_sha256", "spans", "factors")
    keyed = documents.withColumns({"_id": F.coalesce(F.col(key).cast("long"), F.lit(-1)), "_th": F.xxhash64(key, text)})
    narrow = keyed.select("_id", "_th", F.col(text))
    phrase = materialise(_positions(narrow, window), "rlz-positions")
    marks = _marks(phrase).toDF("_mark_id", "_mark_th", "_mark_found", "_mark_lookup")
    base = keyed if keep_text else keyed.select(key, text, "_id", "_th")
    marked = base.join(marks, (F.col("_id") == F.col("_mark_id")) & (F.col("_th") == F.col("_mark_th")), "left").drop("_mark_id", "_mark_th")
    columns = [c for c in base.columns if c not in ("_id", "_th")]
    at = columns.index(text)
    fields = [base.schema[c] for c in columns if keep_text or c != text]
    carried = [i for i, c in enumerate(columns) if keep_text or c != text]
    other = [f"`{f.name}` {f.dataType.simpleString()}" for f in fields]

    # First pass over the texts with their marks: documents with nothing to look up are parsed at once; the others wait,
    # with the windows that need a look.
    pending = "`_id` long, `_th` long, `_text` string, `_found` array<struct<k:int,at:long>>, `_anchor` array<long>, `_window` array<long>, `_k` array<int>, `_at` array<long>"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("substring")
        for batch in batches:
            yield from _first_pass(batch, at, carried, fields, window, keep_text)
        give_back()

    out = materialise(marked.mapInArrow(first, ", ".join([*other, _RESULT_SQL, pending])), "rlz-parsed")
    looked = out.where("_window is not null").select("_id", "_th", F.explode(F.arrays_zip("_anchor", "_window", "_k", "_at")).alias("x")).select("_id", "_th", "x.*")
    # Join both sides as plain scans of written tables.
    looked = materialise(looked, "rlz-windows")
    twice = looked.groupBy("_anchor", "_window").agg(F.min("_at").alias("low"), F.max("_at").alias("high")).where("low != high")
    hits = looked.join(materialise(twice, "rlz-twice"), ["_anchor", "_window"]).select("_id", "_th", F.struct(F.col("_k").alias("k"), _elsewhere("_at").alias("at")).alias("x"))
    hits = hits.groupBy(F.col("_id").alias("_hit_id"), F.col("_th").alias("_hit_th")).agg(F.collect_set("x").alias("_hits"))
    results = [c.split()[0] for c in _RESULT_SQL.split(", ")]
    done = out.where("_window is null").select(*[f.name for f in fields], *results)
    waiting = out.where("_window is not null").select(*[f.name for f in fields], "_id", "_th", "_text", "_found")
    waiting = waiting.join(hits, (F.col("_id") == F.col("_hit_id")) & (F.col("_th") == F.col("_hit_th")), "left").select(*[f"`{f.name}`" for f in fields], "_text", "_found", "_hits")

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("substring")
        for batch in batches:
            yield from _second_pass(batch, fields, window, keep_text)
        give_back()

    final = done.unionByName(waiting.mapInArrow(second, ", ".join([*other, _RESULT_SQL])))
    return final if keep_text else final.drop("kept_text")


def _result(raw: bytes, w: Words, own: slice, places: np.ndarray, window: int, keep_text: bool) -> tuple:
    base = w.start[own][0] - _leading(raw) if own.stop > own.start else 0
    removed, spans, factors, kept = _parse(raw, w.start[own] - base, w.end[own] - base, places, window)
    low = (1 << _POSITION_BITS) - 1
    found = [{"start": a, "end": b, "block": p >> _POSITION_BITS, "position": p & low} for a, b, p in factors]
    return own.stop - own.start, removed, kept.decode() if keep_text else None, hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in spans], found


def _leading(raw: bytes) -> int:
    return len(raw) - len(raw.lstrip(b" \t\n\x0b\x0c\r"))


def _marked(column: pa.Array, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lists of (k, at) in rows a to b: offsets, and all k and at."""
    part = column.slice(a, b - a)
    return part.offsets.to_numpy(), part.values.field("k").to_numpy(), part.values.field("at").to_numpy()


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one range after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _first_pass(batch: pa.RecordBatch, at: int, carried: list[int], fields: list, window: int, keep_text: bool) -> Iterator[pa.RecordBatch]:
    """Documents with their marks -> results, and what those that wait need; a chunk of texts at a time, as lists of
    places take many times the memory of the texts."""
    names = batch.schema.names
    ids, hashes = batch.column(names.index("_id")), batch.column(names.index("_th"))
    for a, b, data, offsets in chunks(batch.column(at)):
        w = words(data, offsets)
        doc, begin, size, anchor, _ = phrases(w, window)
        edges = np.searchsorted(doc, np.arange(b - a + 1))
        found_edges, found_k, found_at = _marked(batch.column(names.index("_mark_found")), a, b)
        look_edges, look_k, look_at = _marked(batch.column(names.index("_mark_lookup")), a, b)
        results: list[tuple] = []
        waits: list[tuple | None] = []
        for d in range(b - a):
            own = w.of(d)
            n = own.stop - own.start
            places = np.full(max(0, n - window + 1), -1, np.int64)
            yes = slice(found_edges[d], found_edges[d + 1])
            if yes.stop > yes.start:
                # Of two places of one phrase the lesser is written last, and stays.
                order = np.lexsort((-found_at[yes], found_k[yes]))
                x = edges[d] + found_k[yes][order]
                places[_ranges(begin[x] - own.start, size[x])] = _ranges(found_at[yes][order], size[x])
            raw = bytes(data[offsets[d] : offsets[d + 1]])
            look = slice(look_edges[d], look_edges[d + 1])
            if look.stop > look.start:
                # A repeated row has each of its phrases at two places; one of them is looked up.
                k, one = np.unique(look_k[look], return_index=True)
                pick = edges[d] + k
                looked = _ranges(begin[pick] - own.start, size[pick])
                real = _ranges(look_at[look][one], size[pick])
                hashed = run_hashes(w.hash[own], window, _WINDOW_BASE)[looked]
                known = np.flatnonzero(places >= 0)
                results.append((n,) + (None,) * (len(_RESULT) - 1))
                waits.append((ids[a + d].as_py(), hashes[a + d].as_py(), raw.decode(), known, places[known], np.repeat(anchor[pick], size[pick]).view(np.int64), hashed.view(np.int64), looked, real))
            else:
                results.append(_result(raw, w, own, places, window, keep_text))
                waits.append(None)
        yield _batch(batch.slice(a, b - a), carried, fields, results, waits)


def _second_pass(batch: pa.RecordBatch, fields: list, window: int, keep_text: bool) -> Iterator[pa.RecordBatch]:
    """Documents that waited, with the places of their windows -> results, a chunk of texts at a time."""
    names = batch.schema.names
    for a, b, data, offsets in chunks(batch.column(names.index("_text"))):
        w = words(data, offsets)
        marks = [_marked(batch.column(names.index(c)), a, b) for c in ("_hits", "_found")]
        rows = []
        for d in range(b - a):
            own = w.of(d)
            places = np.full(max(0, own.stop - own.start - window + 1), -1, np.int64)
            for edges, k, at in marks:
                places[k[edges[d] : edges[d + 1]]] = at[edges[d] : edges[d + 1]]
            rows.append(_result(bytes(data[offsets[d] : offsets[d + 1]]), w, own, places, window, keep_text))
        yield _batch(batch.slice(a, b - a), range(len(fields)), fields, rows)


def _batch(batch, carried, fields, results, waits=None) -> pa.RecordBatch:
    columns = [batch.column(i) for i in carried]
    columns += [pa.array([r[i] for r in results], t) for i, (_, t) in enumerate(_RESULT)]
    names = [*(f.name for f in fields), *(n for n, _ in _RESULT)]
    if waits is not None:
        columns += [pa.array([r and r[i] for r in waits], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
        none = pa.array([r is None for r in waits])

        def lists(i: int, t: pa.DataType, *more: int) -> pa.Array:
            edges = np.cumsum([0, *(0 if r is None else len(r[i]) for r in waits)]).astype(np.int32)
            values = [pa.array(np.concatenate([np.zeros(0, np.int64), *(r[j] for r in waits if r is not None)]), pa.int64()) for j in (i, *more)]
            values[0] = values[0].cast(t)
            return pa.ListArray.from_arrays(edges, pa.StructArray.from_arrays(values, ["k", "at"]) if more else values[0], mask=none)

        columns += [lists(3, pa.int32(), 4), lists(5, pa.int64()), lists(6, pa.int64()), lists(7, pa.int32()), lists(8, pa.int64())]
        names += ["_id", "_th", "_text", "_found", "_anchor", "_window", "_k", "_at"]
    return pa.RecordBatch.from_arrays(columns, names)
