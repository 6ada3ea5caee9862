"""Token ids as Arrow files of equal-length sequences.

Documents are ordered by id over range partitions. Each partition writes one shard: an Arrow IPC file whose
record batches hold fixed-size lists (``input_ids`` and ``mask``, one list per sequence), and a small index
file (doc_id, offset, length). Nothing in the files is compressed, so a reader maps them and takes
sequence k of a shard, or the ids of a document, without copying or decoding. The last sequence of a
shard is padded; its mask is false there. A failed or repeated task leaves a file that no manifest names.

Defined cases: a null or empty text is its end id alone; documents without an id come first; rows with equal
ids follow each other in order of their texts; an empty table gives one empty shard or none. Only the id
and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import os
import sys
import unicodedata
import uuid
import zlib
from collections.abc import Iterable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsieve.llm import bytewords as bw
from mailsieve.operators.durable import durable, scratch_path

END_ID = 2
SEQUENCE = 2048
#: Sequences in a record batch: 4 MB of 16-bit ids.
BATCH_ROWS = 1024
#: Words that a task remembers with their ids; beyond it the memory starts afresh.
REMEMBERED = 2_000_000
# The vocabulary's own word splitting drops white space and always parts an ASCII letter from one of these marks
# behind it, so cutting there changes no id.
_CUT = np.ones(256, bool)
_CUT[[10, 32]] = False
_MARK, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_MARK[list(b".,!?;:*$#%&()")] = True
_LETTER[97:123] = True
#: Plain words are encoded so many at a time, as one text.
_TOGETHER = 256


def _plain(word: str) -> bool:
    """Is the word one unit of the vocabulary's splitting, unchanged by its normal form?"""
    return word.isalpha() and (word.isascii() or (unicodedata.is_normalized("NFC", word) and "\u0130" not in word))


def _tokenizer(path: str) -> tuple:
    """(tokenizer, which of its ids end a word), loaded once by a process.

    A dropped tokenizer leaves megabytes of native memory behind, so one a task would fill a worker. It is kept beside
    the process's modules, as every task has its own copy of this one.
    """
    held = vars(sys.modules.setdefault("_mailsieve_held", ModuleType("_mailsieve_held")))
    if path not in held:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        vocabulary = tokenizer.get_vocab()
        ends = np.zeros(max(vocabulary.values()) + 1, bool)
        ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        held[path] = tokenizer, ends
    return held[path]


class WordEncoder:
    """Ids of whole texts by way of their words, each encoded once and remembered by its hash.

    Right for vocabularies that lower-case, never join across white space and drop it; then the ids of a
    text are those of its words in order. ``tests/llm`` compares it with encoding whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer, self.ends = _tokenizer(path)
        self.clear()

    def clear(self) -> None:
        self.keys, self.start, self.length = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 20, np.uint16), 0

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids joined, number of ids of each word)."""
        length, parts = np.zeros(len(words), np.int64), [np.zeros(0, np.uint16)] * len(words)
        plain = [i for i, w in enumerate(words) if _plain(w)]
        groups = [plain[k : k + _TOGETHER] for k in range(0, len(plain), _TOGETHER)]
        rest = [i for i, w in enumerate(words) if not _plain(w)]
        for group, coded in zip(groups, self.tokenizer.encode_batch_fast([" ".join(words[i] for i in g) for g in groups], add_special_tokens=False)):
            ids = np.array(coded.ids, np.uint16)
            upto = np.flatnonzero(self.ends[ids]) + 1
            if len(upto) != len(group):
                rest += group
                continue
            for i, part in zip(group, np.split(ids, upto[:-1])):
                parts[i] = part
        for i, coded in zip(rest, self.tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False)):
            parts[i] = np.array(coded.ids, np.uint16)
        length[:] = [len(p) for p in parts]
        return np.concatenate([*parts, np.zeros(0, np.uint16)]), length

    def _add(self, keys: np.ndarray, words: list[str]) -> None:
        ids, length = self._ids(words)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint16)])
        self.ids[self.used : self.used + len(ids)] = ids
        at = np.searchsorted(self.keys, keys)
        self.start = np.insert(self.start, at, self.used + np.cumsum(length) - length)
        self.length = np.insert(self.length, at, length)
        self.keys = np.insert(self.keys, at, keys)
        self.used += len(ids)

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts joined, each with its end id; number of ids of each)."""
        if len(self.keys) > REMEMBERED:
            self.clear()
        low = bw.LOWER[data]
        start, end, first = bw.word_spans(low, offsets, _CUT)
        if len(low):
            begins, ends = np.zeros(len(low), bool), np.zeros(len(low), bool)
            begins[start], ends[end - 1] = True, True
            parted = np.flatnonzero(_MARK[low[1:]] & _LETTER[low[:-1]])
            begins[parted + 1], ends[parted] = True, True
            start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
            first = np.searchsorted(start, offsets)
        distinct, where, which = np.unique(bw.word_hashes(low, start, end), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, distinct)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == distinct[known]
        if not known.all():
            raw, new = low.tobytes(), where[~known]
            self._add(distinct[~known], [raw[a:b].decode() for a, b in zip(start[new].tolist(), end[new].tolist())])
            at = np.searchsorted(self.keys, distinct)
        index = at[which]
        length = self.length[index]
        ids = self.ids[bw.take_ranges(self.start[index], length)]
        n_tokens = np.diff(np.concatenate([[0], np.cumsum(length)])[first]) + 1
        return np.insert(ids, np.cumsum(n_tokens - 1), np.uint16(end_id)), n_tokens


def sequence_schema(sequence: int) -> pa.Schema:
    return pa.schema([("input_ids", pa.list_(pa.uint16(), sequence)), ("mask", pa.list_(pa.bool_(), sequence))])


class ShardWriter:
    """Cuts a run of ids into equal sequences and writes them a record batch at a time."""

    def __init__(self, sink, sequence: int):
        self.size, self.schema = sequence, sequence_schema(sequence)
        self.out = pa.ipc.new_file(sink, self.schema)
        self.parts: list[np.ndarray] = []
        self.held = 0

    def write(self, ids: np.ndarray) -> None:
        self.parts.append(ids)
        self.held += len(ids)
        while self.held >= self.size * BATCH_ROWS:
            joined = np.concatenate(self.parts)
            full = self.size * BATCH_ROWS
            self._put(joined[:full], full)
            self.parts, self.held = [joined[full:]], len(joined) - full

    def _put(self, ids: np.ndarray, used: int) -> None:
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(v), self.size) for v in (ids, np.arange(len(ids)) < used)]
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if self.held:
            rest = np.concatenate(self.parts)
            self._put(np.pad(rest, (0, -len(rest) % self.size)), len(rest))
        self.out.close()


INDEX = pa.schema([("doc_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])


def write_shards(docs: DataFrame, folder: str, vocabulary: str, sequence: int = SEQUENCE, end_id: int = END_ID, shards: int | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write them in id order below ``folder``; returns the manifest.

    The manifest has one row per shard in order: (shard, path, n_docs, n_ids).
    """
    spark = docs.sparkSession
    count = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}"
        coder, docs_n, ids_n = WordEncoder(vocabulary), 0, 0
        with store.open_output_stream(f"{root}/{name}.arrow") as sink, store.open_output_stream(f"{root}/{name}.index.arrow") as side:
            ids_out, index_out = ShardWriter(sink, sequence), pa.ipc.new_file(side, INDEX)
            for rows, data, offsets in bw.text_blocks(batches, "text"):
                ids, n_tokens = coder.encode(data, offsets, end_id)
                ids_out.write(ids)
                ends = ids_n + np.cumsum(n_tokens)
                index_out.write_batch(pa.RecordBatch.from_arrays([rows.column(0), pa.array(ends - n_tokens), pa.array(n_tokens)], schema=INDEX))
                docs_n, ids_n = docs_n + len(n_tokens), ids_n + int(n_tokens.sum())
            ids_out.close()
            index_out.close()
        if docs_n:
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [f"{folder}/{name}"], "n_docs": [docs_n], "n_ids": [ids_n]})

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(count, "doc_id").sortWithinPartitions("doc_id", "text")
    return durable(ordered.mapInArrow(write, "shard long, path string, n_docs long, n_ids long"), "manifest")


def open_shard(path: str) -> tuple[pa.ipc.RecordBatchFileReader, pa.ipc.RecordBatchFileReader]:
    """Readers of a shard's sequences and of its index, mapped where the store is a local folder."""
    store, root = fs.FileSystem.from_uri(path)
    local = isinstance(store, fs.LocalFileSystem)
    return tuple(pa.ipc.open_file(pa.memory_map(root + end) if local else store.open_input_file(root + end)) for end in (".arrow", ".index.arrow"))


class ShardIds:
    """Ids of a shard by position; touches only the record batches asked for."""

    def __init__(self, reader: pa.ipc.RecordBatchFileReader):
        self.reader, self.at, self.flat = reader, -1, np.zeros(0, np.uint16)
        self.width = reader.schema.field("input_ids").type.list_size * BATCH_ROWS

    def batch(self, k: int) -> np.ndarray:
        if self.at != k:
            self.at, self.flat = k, self.reader.get_batch(k).column(0).flatten().to_numpy(zero_copy_only=True)
        return self.flat

    def pieces(self, start: int, length: int) -> Iterator[np.ndarray]:
        while length:
            part = self.batch(start // self.width)[start % self.width :][:length]
            yield part
            start, length = start + len(part), length - len(part)


def read_documents(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files that the manifest names."""
    # One row per shard: bounded by the number of partitions that wrote.
    shards = manifest.orderBy("shard").collect()
    base, rows = 0, []
    for s in shards:
        rows.append((s.path, base, s.n_ids))
        base += s.n_ids

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                sequences, index = open_shard(shard["path"])
                ids, seen = ShardIds(sequences), 0
                for k in range(index.num_record_batches):
                    part = index.get_batch(k)
                    start, length = part.column(1).to_numpy(), part.column(2).to_numpy()
                    crcs = np.zeros(len(start), np.int64)
                    for i, (a, n) in enumerate(zip(start.tolist(), length.tolist())):
                        crc = 0
                        for piece in ids.pieces(a, n):
                            crc = zlib.crc32(piece.astype("<u4"), crc)
                        crcs[i] = crc
                    seen += int(length.sum())
                    out = [part.column(0), pa.array(start + shard["base"]), part.column(2), pa.array(crcs)]
                    yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "n_tokens", "ids_crc32"])
                if seen != shard["n_ids"]:
                    raise ValueError(f"{shard['path']} holds {seen} ids, its manifest says {shard['n_ids']}")

    named = spark.createDataFrame(rows, "path string, base long, n_ids long").repartition(max(1, len(rows)))
    return named.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, vocabulary: str | None = None, folder: str | None = None, **options) -> DataFrame:
    """Write ``docs`` as token files and read every document's place, length and checksum back."""
    spark = docs.sparkSession
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    folder = folder or scratch_path(spark, "tokens")
    return read_documents(spark, write_shards(docs, folder, vocabulary, **options))
