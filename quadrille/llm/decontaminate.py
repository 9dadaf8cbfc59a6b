"""Benchmark decontamination: one Aho-Corasick automaton over the normalised test items scans every text once.

Words are normalised by lower-casing A-Z and cutting at every other ASCII character that is no digit or
letter. A window is `window` consecutive words of an item; a shorter item, unless empty, is one window.
The automaton holds each distinct window once, framed by blanks so that matches stand on word borders, and each
text is scanned once. Matches are mapped back to word numbers and to character offsets of the original text.

Nulls and empty texts have no words and no hits. Items without a word match nothing, so an empty item table
marks nothing. Items that repeat a text count each under their own id; items with a null id are left out, as
they could not be named in a result. Repeated document rows are scanned each on its own; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import give_back, take_over

#: Item bytes in one automaton, and in one broadcast. An item table is far smaller as a rule; a larger one is scanned in
#: several blocks in turn, of which a worker holds one automaton at a time.
BLOCK_BYTES = 8 << 20
WINDOW = 8

_TABLE = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_CUT = np.frombuffer(_TABLE, np.uint8) == 32


def normalise(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def item_windows(words: list[bytes], window: int) -> set[str]:
    if not words:
        return set()
    return {b" ".join(words[i : i + window]).decode() for i in range(max(1, len(words) - window + 1))}


@lru_cache(maxsize=1)
def _automaton(items: tuple[tuple[int, str], ...], window: int):
    owners: dict[str, set[int]] = {}
    for item_id, text in items:
        for w in item_windows(normalise(text), window):
            owners.setdefault(w, set()).add(item_id)
    machine = ahocorasick.Automaton()
    for w, ids in owners.items():
        machine.add_word(f" {w} ", (w.count(" ") + 1, tuple(sorted(ids))))
    if owners:
        machine.make_automaton()
    return machine, bool(owners)


def scan(text: str | None, machine, any_window: bool) -> tuple[int, np.ndarray, set[int], list[tuple[int, int]]]:
    """Number of words, flags of the words hit, ids of the items found, and (first word, number of words) of each match."""
    words = normalise(text)
    if not words or not any_window:
        return len(words), np.zeros(0, bool), set(), []
    flat = (b" " + b" ".join(words) + b" ").decode()
    found = list(machine.iter(flat))
    if not found:
        return len(words), np.zeros(0, bool), set(), []
    # Blanks in the flat text: the i-th blank stands before word i.
    blanks = np.flatnonzero(np.frombuffer(flat.encode("utf-32-le"), np.uint32) == 32)
    ends = np.searchsorted(blanks, np.array([e for e, _ in found]))
    counts = np.array([v[0] for _, v in found])
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, ends - counts, 1)
    np.add.at(edge, ends, -1)
    ids: set[int] = set().union(*(v[1] for _, v in found))
    return len(words), np.cumsum(edge[:-1]) > 0, ids, list(zip((ends - counts).tolist(), counts.tolist(), strict=True))


def original_spans(text: str, hit: np.ndarray) -> list[dict[str, int]]:
    """Character ranges of the original text under maximal runs of hit words."""
    raw = np.frombuffer(text.encode(), np.uint8)
    inside = np.concatenate([[False], ~_CUT[raw], [False]])
    begins, ends = np.flatnonzero(~inside[:-1] & inside[1:]), np.flatnonzero(inside[:-1] & ~inside[1:])
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    flags = np.concatenate([[False], hit, [False]]).astype(np.int8)
    step = np.diff(flags)
    return [{"start": int(chars[begins[a]]), "end": int(chars[ends[b - 1]])} for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True)]


def item_blocks(items: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[tuple[tuple[int, str], ...]]:
    """Items in blocks of bounded size, streamed through the driver one block at a time; each becomes one automaton."""
    block: list[tuple[int, str]] = []
    held = 0
    rows = items.select(F.col(item_id).cast("long"), F.coalesce(F.col(text), F.lit(""))).where(F.col(item_id).isNotNull()).distinct().orderBy(*[1, 2])
    for i, t in rows.toLocalIterator():
        if block and held + len(t.encode()) > block_bytes:
            yield tuple(block)
            block, held = [], 0
        block.append((i, t))
        held += len(t.encode())
    if block:
        yield tuple(block)


_SCHEMA = "n_words long, n_hit long, n_items long, item_ids array<long>, spans array<struct<start:long,end:long>>"


def contamination(documents: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, min_items: int = 2, keep_text: bool = True) -> DataFrame:
    """The documents with a struct column `contamination`: word and hit counts, the items found, spans of the original text.

    Columns of the documents that bear the names of the two results are replaced. keep_text: whether the text stays.
    An item table of more than one block costs one automaton per block in turn in the same pass over the texts.
    """
    spark = documents.sparkSession
    documents = documents.drop("contamination", "contaminated")
    blocks = [spark.sparkContext.broadcast(b) for b in item_blocks(items, item_id, item_text, block_bytes)]
    at = documents.columns.index(text)
    kept = [i for i in range(len(documents.columns)) if keep_text or i != at]
    fields = [documents.schema.fields[i] for i in kept]
    kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("item_ids", pa.list_(pa.int64())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("decontaminate", _automaton.cache_clear)
        for batch in batches:
            texts = batch.column(at)
            found: list[tuple[int, np.ndarray, set[int]]] = [(0, np.zeros(0, bool), set())] * len(texts)
            for j, b in enumerate(blocks):
                machine = _automaton(b.value, window)
                for i, t in enumerate(texts):
                    n, hit, ids, _ = scan(t.as_py(), *machine)
                    if j:
                        _, h, before = found[i]
                        hit, ids = h if not len(hit) else (hit | h if len(h) else hit), ids | before
                    found[i] = (n, hit, ids)
            if not blocks:
                found = [(len(normalise(t.as_py())), np.zeros(0, bool), set()) for t in texts]
            rows = [{"n_words": n, "n_hit": int(hit.sum()), "n_items": len(ids), "item_ids": sorted(ids), "spans": original_spans(t.as_py(), hit) if len(hit) else []} for t, (n, hit, ids) in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(rows, kind)], [*(f.name for f in fields), "contamination"])
        give_back()

    out = documents.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"contamination struct<{_SCHEMA.replace(' long', ':long').replace(' array', ':array')}>"]))
    return out.withColumn("contaminated", F.col("contamination.n_items") >= min_items)

