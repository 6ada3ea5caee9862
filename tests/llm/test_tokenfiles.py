import random
import zlib

import common as c
import numpy as np
import public_tokenizers
import pytest
from pyspark import cloudpickle
from tokenizers import Tokenizer

from mailsieve.llm import bytewords as bw
from mailsieve.llm import tokenfiles as tf

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def whole():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def expected(rows, whole):
    """Rows in order of id, nulls first, then text."""
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = whole(t)
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[1], r[2]))


def test_whole_documents(spark, sf, whole):
    docs = c.documents(spark, sf)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert order(tf.token_files(docs).collect()) == expected(rows, whole)


def test_words_give_the_ids_of_whole_texts(whole):
    """Odd marks, special tokens, contractions, combining characters and all kinds of white space."""
    import pyarrow as pa

    rng = random.Random(7)
    bits = ["a", "Bc", "É", "é", "İ", "ς", "Σ", "'s", "'", "<|endoftext|>", "<|", "|>", ",", ".", "!!", "$%", " ", "\n", "\t", " ", " ", "\x1c", "7", "12", "漢字", "ﬁ", "̸", "<", "😀", "ͅ", "ǆ", "_", "-", "Ⅷ", "٣"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(6000)]
    coder = tf.WordEncoder(PATH)
    for _, data, offsets in bw.text_blocks([pa.RecordBatch.from_pydict({"text": texts})], max_bytes=4096):
        ids, n = coder.encode(data, offsets, 2)
        own = [data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:])]
        for text, part in zip(own, np.split(ids, np.cumsum(n)[:-1])):
            assert part.tolist() == whole(text), text


def test_memory_of_words_may_start_afresh(monkeypatch, whole):
    import pyarrow as pa

    monkeypatch.setattr(tf, "REMEMBERED", 3)
    coder = tf.WordEncoder(PATH)
    for text in ("one two three four", "five one six", "two seven"):
        (_, data, offsets), = bw.text_blocks([pa.RecordBatch.from_pydict({"text": [text]})])
        assert coder.encode(data, offsets, 2)[0].tolist() == whole(text)


def test_files_hold_equal_sequences_and_masks(spark, sf, tmp_path, whole, monkeypatch):
    docs = c.documents(spark, sf).select("doc_id", "text")
    manifest = tf.write_shards(docs, f"{tmp_path}/t", PATH, sequence=64, shards=3)
    shards = manifest.orderBy("shard").collect()
    assert len(shards) == 3
    texts = {r.doc_id: r.text for r in docs.collect()}
    for shard in shards:
        sequences, index = tf.open_shard(shard.path)
        assert sequences.schema == tf.sequence_schema(64)
        table, docs_of = sequences.read_all(), index.read_all()
        ids = np.concatenate([x.flatten().to_numpy() for x in table.column(0).chunks])
        mask = np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in table.column(1).chunks])
        assert mask.sum() == shard.n_ids and mask[: shard.n_ids].all() and len(ids) % 64 == 0
        for d, at, n in zip(*(docs_of.column(k).to_pylist() for k in range(3))):
            assert ids[at : at + n].tolist() == whole(texts[d])
    sequences, _ = tf.open_shard(shards[0].path)
    reader = tf.ShardIds(sequences)
    assert np.concatenate(list(reader.pieces(100, 300))).tolist() == np.concatenate([x.flatten().to_numpy() for x in sequences.read_all().column(0).chunks])[100:400].tolist()


def test_documents_over_several_batches(spark, monkeypatch, whole):
    rows = [(i, f"text {i} " + "word " * (i % 7)) for i in range(100)] + [(200, c.LONG)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert order(tf.token_files(docs, sequence=4, shards=2).collect()) == expected(rows, whole)


def test_edges(spark, whole):
    assert order(tf.token_files(c.edge_docs(spark)).collect()) == expected([r[:2] for r in c.EDGE], whole)
    assert tf.token_files(c.no_docs(spark)).count() == 0


def test_workers_keep_no_encoder(spark):
    """An encoder holds a vocabulary and all words it met, and idle workers stay alive."""

    def left(batches):
        import gc
        import os
        import time

        import pyarrow as pa

        for _ in batches:
            time.sleep(0.2)  # so that the tasks take different workers
        gc.unfreeze()
        yield pa.RecordBatch.from_pydict({"pid": [os.getpid()], "n": [sum(type(o).__name__ == "WordEncoder" for o in gc.get_objects())]})

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(64)], "doc_id long, text string")
    for _ in range(2):
        assert tf.token_files(docs, shards=16).count() == 64
    found = spark.range(16).repartition(16).mapInArrow(left, "pid long, n long").collect()
    assert found and max(r.n for r in found) == 0


def test_a_process_loads_its_tokenizer_once():
    """Every task has a copy of the library, and each tokenizer that is dropped leaves memory behind."""
    copies = [cloudpickle.loads(cloudpickle.dumps(lambda: tf.WordEncoder(PATH).tokenizer)) for _ in range(2)]
    assert copies[0]() is copies[1]() is tf.WordEncoder(PATH).tokenizer
