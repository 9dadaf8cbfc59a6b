"""Token-ID output: length-delimited binary records with masked checksums and a separate offset index.

A record frames one sequence:

    length   unsigned 64-bit   bytes of the payload
    check    unsigned 32-bit   masked CRC-32 of the eight length bytes
    payload  key (signed 64-bit), bytes per id (unsigned 8-bit), ids
    check    unsigned 32-bit   masked CRC-32 of the payload

All numbers are little-endian. A checksum c is stored masked, as (c rotated right by 15) + 0xA282EAD8 modulo 2**32,
so that a checksum over data that holds checksums stays sound. Ids take two bytes where the vocabulary allows it.
The index of a data file is one table row per record: file, record, key, offset and size in bytes, number of ids,
number of ids before it in the file. A shuffled reader draws index rows in any order and reads each record alone.

Writers run on the executors, each task writing files with names of its own through pyarrow's file systems into
the shared folder. The index is written by Spark's own commit protocol and names the files of successful attempts
only, so files left by a lost executor are never read.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import give_back, scratch_path, take_over

#: Fixed value of the checksum mask.
MASK_DELTA = 0xA282EAD8
#: Bytes after which a task starts its next data file.
FILE_BYTES = 64 << 20
#: Distinct text pieces a worker keeps encoded, and their characters; when full, it starts anew. It bounds memory, not what is encoded.
CACHE_PIECES, CACHE_CHARS = 700_000, 32 << 20
END_ID = 0


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(key: int, ids: np.ndarray, width: int) -> bytes:
    payload = struct.pack("<qB", key, width) + ids.astype("<u2" if width == 2 else "<u4").tobytes()
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


def unframe(data: bytes | memoryview, offset: int = 0) -> tuple[int, np.ndarray, int]:
    """Key, ids and the offset after the record; raises ValueError if a length or checksum doesn't hold."""
    if len(data) < offset + 12:
        raise ValueError(f"record at {offset} is cut short")
    (n,), (check,) = struct.unpack_from("<Q", data, offset), struct.unpack_from("<I", data, offset + 8)
    if check != masked(bytes(data[offset : offset + 8])):
        raise ValueError(f"length at {offset} fails its checksum")
    at = offset + 12
    if len(data) < at + n + 4:
        raise ValueError(f"record at {offset} is cut short")
    payload = data[at : at + n]
    if struct.unpack_from("<I", data, at + n)[0] != masked(bytes(payload)):
        raise ValueError(f"payload at {at} fails its checksum")
    key, width = struct.unpack_from("<qB", payload)
    return key, np.frombuffer(payload, "<u2" if width == 2 else "<u4", offset=9).astype("<u4"), at + n + 4


_BREAK = re.compile(r"(?<=[^\s])(?= [^\s])|(?<=[^\s])(?=\n[^\s])|(?<=[^\s]\n)(?=[^\s])")


#: The white space of the splitting rule besides blanks and line feeds, as ranges of code points.
_OTHER_SPACE = r"\t\r\v\f\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Texts with runs of white space, white space at an end, or other white space are cut by _BREAK; in all others every blank and line feed is a cut.
_RUNS = rf"[ \n][ \n]|\A[ \n]|[ \n]\z|[{_OTHER_SPACE}]"
_CUT = "\0"
_PLAIN = rf"\A ?[^ \n{_OTHER_SPACE}]+\z"
#: Pieces that are encoded in one line, and lines or pieces in one call, which bounds the encodings held at a time.
LINE_PIECES, CALL_LINES = 100, 64


class PieceEncoder:
    """Encodes texts with a byte-level BPE tokenizer, each distinct piece of text once.

    The tokenizer's splitting rule never joins a character that is not white space to a single blank or line feed
    and the visible character after it, so a text cut before each such blank, and on both sides of each such line
    feed, has the ids of its pieces in a row. Longer runs of white space stay inside a piece. The tokenizers library
    encodes every piece; ids are then copied from its results. Texts are cut and their pieces numbered as Arrow columns,
    so Python sees each distinct piece of a group once.
    """

    def __init__(self, path: str, limit: int = CACHE_PIECES):
        from tokenizers import Tokenizer

        # The tasks of an executor share its cores; threads of each task's own would only contend for them.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None
        # Texts that hold an added token's string are encoded whole: its splitting comes before the pieces'.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used, self.chars, self.at = 0, 0, np.zeros(1 << 12, np.int64)

    def pieces(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Pieces of all texts in a row, and where each text's begin; texts that must stay whole are one piece."""
        whole = pc.match_substring(texts, _CUT)
        for a in self.added:
            whole = pc.or_(whole, pc.match_substring(texts, a))
        runs = pc.and_not(pc.match_substring_regex(texts, _RUNS), whole)
        marked = pc.replace_substring(pc.replace_substring(texts, "\n", f"{_CUT}\n{_CUT}"), " ", f"{_CUT} ")
        if pc.any(runs).as_py():
            own = pa.array([_CUT.join(_BREAK.split(t)) for t in texts.filter(runs).to_pylist()], texts.type)
            marked = pc.replace_with_mask(marked, runs, own)
        if pc.any(whole).as_py():
            # A cut mark may stand in such a text, so it is kept out of the splitting and put back as one piece.
            marked = pc.replace_with_mask(marked, whole, pa.array([""] * pc.sum(whole).as_py(), texts.type))
        lists = pc.split_pattern(marked, _CUT)
        at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        flat = lists.flatten()
        if pc.any(whole).as_py():
            mask = np.zeros(len(flat), bool)
            mask[at[:-1][whole.to_numpy(zero_copy_only=False)]] = True
            flat = pc.replace_with_mask(flat, pa.array(mask), texts.filter(whole))
        return flat, at

    def ids_in_calls(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text. Nobody asks for offsets, so none are tracked."""
        for i in range(0, len(texts), CALL_LINES):
            for x in self.tokenizer.encode_batch_fast(texts[i : i + CALL_LINES], add_special_tokens=False):
                yield x.ids

    def ids_of(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and how many each has.

        Pieces of visible characters, with or without a blank before them, are encoded in lines of many: a line feed between
        two of them is a token of its own. All others are encoded one by one.
        """
        plain = pc.match_substring_regex(pa.array(new, pa.large_string()), _PLAIN).to_numpy(zero_copy_only=False)
        sizes = np.zeros(len(new), np.int64)
        lists: list[list[int]] = []
        texts = [p for p, x in zip(new, plain, strict=True) if x]
        if self.line is not None and texts:
            for ids in self.ids_in_calls(["\n".join(texts[i : i + LINE_PIECES]) for i in range(0, len(texts), LINE_PIECES)]):
                lists += [ids, [self.line]]
            flat = np.array(list(chain.from_iterable(lists)), np.uint32)
            ends = np.flatnonzero(flat == self.line)
            if len(ends) != len(texts):
                raise ValueError("a piece of text holds the token of a line feed")
            sizes[plain] = np.diff(ends, prepend=-1) - 1
            many = flat[flat != self.line]
        else:
            plain[:] = False
            many = np.zeros(0, np.uint32)
        others = list(self.ids_in_calls([p for p, x in zip(new, plain, strict=True) if not x]))
        sizes[~plain] = [len(x) for x in others]
        after = np.cumsum(sizes)
        ids = np.zeros(int(after[-1]), np.uint32)
        owner = np.repeat(plain, sizes)
        ids[owner] = many
        ids[~owner] = np.array(list(chain.from_iterable(others)), np.uint32)
        return ids, sizes

    def learn(self, new: list[str]) -> None:
        ids, sizes = self.ids_of(new)
        first = len(self.known)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + len(new) + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.at[first + 1 : first + len(new) + 1] = self.used + np.cumsum(sizes)
        self.used += len(ids)
        self.chars += sum(map(len, new))
        self.known.update(zip(new, range(first, first + len(new)), strict=True))

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin; the pieces that are new are encoded in one call."""
        if len(self.known) > self.limit or self.chars > CACHE_CHARS:
            self.clear()
        flat, at = self.pieces(texts)
        coded = flat.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        numbers = list(map(self.known.get, distinct))
        if None in numbers:
            self.learn([p for p, k in zip(distinct, numbers, strict=True) if k is None])
            numbers = list(map(self.known.__getitem__, distinct))
        k = np.array(numbers, np.int64)[coded.indices.to_numpy()]
        start = self.at[k]
        size = self.at[k + 1] - start
        after = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(start - after[:-1], size) + np.arange(after[-1])]
        return ids, after[at]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all(pa.array([text], pa.large_string()))[0]


@lru_cache(maxsize=1)
def _encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


INDEX = "part int, file string, record long, key long, is_null boolean, offset long, size long, n_ids long, before long"
_INDEX = pa.schema([("part", pa.int32()), ("file", pa.string()), ("record", pa.int64()), ("key", pa.int64()), ("is_null", pa.bool_()), ("offset", pa.int64()), ("size", pa.int64()), ("n_ids", pa.int64()), ("before", pa.int64())])


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if re.match(r"\w+:", uri) else f"file://{uri}")


#: Bytes of text encoded together; a longer text is encoded alone.
GROUP_BYTES = 3 << 20


def encoded(encoder: PieceEncoder, batch: pa.RecordBatch) -> Iterator[tuple[int | None, np.ndarray]]:
    keys, texts = batch.column(0).to_pylist(), batch.column(1)
    size = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
    first = 0
    while first < len(keys):
        base = size[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(size, base + GROUP_BYTES, "right")))
        ids, at = encoder.encode_all(texts.slice(first, end - first).cast(pa.large_string()))
        for j in range(first, end):
            yield keys[j], ids[at[j - first] : at[j - first + 1]]
        first = end


def write_records(documents: DataFrame, folder: str, tokenizer: str, *, key: str = "doc_id", text: str = "text", end_id: int | None = END_ID, file_bytes: int = FILE_BYTES, partitions: int | None = None) -> DataFrame:
    """Encodes every whole text, appends end_id, and writes records into `folder` in ascending order of the key.

    Rows are dealt by ranges of the key and sorted within them; rows that share a key follow each other, ordered by
    their text, and null keys come first. A null text counts as empty, so its record holds the end id alone. An
    empty table gives an empty index. Columns besides key and text are not written. Returns the offset index, which
    is also written to folder/index.
    """
    from pyspark import TaskContext

    spark = documents.sparkSession
    rows = documents.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # Rows of one key differ in nothing but the text; the text's hash as second key keeps ranges even.
    deal = [F.col("key").asc_nulls_first(), F.xxhash64("text")]
    rows = rows.repartitionByRange(partitions, *deal) if partitions else rows.repartitionByRange(*deal)
    rows = rows.sortWithinPartitions(*deal, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _file_system(folder)
        part, encoder = TaskContext.get().partitionId(), _encoder(tokenizer)
        take_over("token_records", encoder.clear)
        out, name, offset, before, record, number = None, "", 0, 0, 0, 0
        end = np.array([] if end_id is None else [end_id], np.uint32)
        for batch in batches:
            held: list[tuple] = []
            for k, found in encoded(encoder, batch):
                if out is None or offset >= file_bytes:
                    if out is not None:
                        out.close()
                    name = f"{base}/data/{part:06d}-{number:04d}-{uuid.uuid4().hex}.rec"
                    system.create_dir(f"{base}/data", recursive=True)
                    out, offset, before, record, number = system.open_output_stream(name), 0, 0, 0, number + 1
                ids = np.concatenate([found, end])
                data = frame(k or 0, ids, encoder.width)
                out.write(data)
                held.append((part * 10_000 + number, name, record, k or 0, k is None, offset, len(data), len(ids), before))
                offset, before, record = offset + len(data), before + len(ids), record + 1
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _INDEX.types, strict=True)], schema=_INDEX)
        if out is not None:
            out.close()
        give_back()

    rows.mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def read_records(spark: SparkSession, folder: str, function, schema: str) -> DataFrame:
    """Applies function(file, index rows, records) to each data file; records is an iterator of (key, ids) in file order.

    One task reads one file from front to end; files are of bounded size. A record whose checksum fails raises.
    """
    index = spark.read.schema(INDEX).parquet(f"{folder}/index")
    files = index.groupBy("part", "file").agg(F.sum("size").alias("bytes"), F.sum("n_ids").alias("ids"))
    # Rows here are small and files are not: as many tasks as the index has parts (one per writing task), never joined into fewer.
    files = files.repartition(max(1, len(index.inputFiles())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, _ = _file_system(folder)
                with system.open_input_stream(row["file"]) as stream:
                    yield from function(row, _records(stream))

    return files.mapInArrow(run, schema)


def _records(stream) -> Iterator[tuple[int, np.ndarray]]:
    while head := stream.read(12):
        if len(head) < 12:
            raise ValueError("a length is cut short")
        (n,) = struct.unpack_from("<Q", head)
        if struct.unpack_from("<I", head, 8)[0] != masked(head[:8]):
            raise ValueError("a length fails its checksum")
        key, ids, _ = unframe(head + stream.read(n + 4))
        yield key, ids


def record_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Per record, from the files alone: key, number of ids before it in all files, number of ids, CRC-32 of the ids as 32-bit integers.

    Ids before a file are a running sum over files, one row each, in the order of their number.
    """
    schema = "part int, record long, doc_id long, before long, n_tokens long, ids_crc32 long"
    kind = pa.schema([("part", pa.int32()), ("record", pa.int64()), ("doc_id", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(row: dict, records: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        held, before = [], 0
        for i, (key, ids) in enumerate(records):
            held.append((row["part"], i, key, before, len(ids), zlib.crc32(ids.tobytes())))
            before += len(ids)
        if before != row["ids"]:
            raise ValueError(f"{row['file']} has {before} ids, its index {row['ids']}")
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kind.types, strict=True)], schema=kind)

    digests = read_records(spark, folder, run, schema)
    index = spark.read.schema(INDEX).parquet(f"{folder}/index")
    ahead = running_totals(index.groupBy("part").agg(F.sum("n_ids").alias("n")), "part", "n")
    nulls = index.where("is_null").select("part", "record", "is_null")
    out = digests.join(ahead, "part").withColumn("start", F.col("ahead") + F.col("before"))
    return out.join(nulls, ["part", "record"], "left").select(F.when(F.col("is_null").isNull(), F.col("doc_id")).alias("doc_id"), "start", "n_tokens", "ids_crc32")


def running_totals(sums: DataFrame, order: str, value: str) -> DataFrame:
    """`ahead`: sum of value over the rows before, for one row per output file: a few thousand rows per TB."""
    from pyspark.sql import Window

    return sums.select(order, (F.sum(value).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1))).alias("ahead")).na.fill(0, ["ahead"])


def write_and_digest(documents: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    spark = documents.sparkSession
    folder = folder or scratch_path(spark, "records")
    write_records(documents, folder, tokenizer)
    return record_digests(spark, folder)
