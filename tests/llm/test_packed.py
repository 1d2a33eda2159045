"""Packed token ids: bits, files, random access, and the whole round trip against the tokenizer."""

import glob
import json
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from labtide.llm import packed, queries
from labtide.llm.common import table

public_tokenizers, tokenizers = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers")
SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = tokenizers.Tokenizer.from_file(VOCABULARY)
PARTS = [*" \t\n\r\x0b\x1c\x85\xa0\u2028\u3000\u200b\u0301'sdl.,!#<|>", "a", "é", "漢", "5", "🎈", "'ll ", " \n ", "<|endoftext|>", " the"]
ENCODER = packed.Encoder(open(VOCABULARY, encoding="utf-8").read(), "<u2")


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.integers(0, 70), st.integers(0, 2**32 - 1))
def test_bits_come_back(width, count, seed):
    ids = np.random.default_rng(seed).integers(0, 1 << width, count).astype(np.uint32)
    data = packed.pack(ids, width)
    assert len(data) == -(-count * width // 8) and packed.unpack(data, count, width).tolist() == ids.tolist()


def test_bits_run_from_low_to_high():
    whole = sum(v << (5 * i) for i, v in enumerate([1, 31, 0, 7, 16, 2]))
    assert packed.pack(np.array([1, 31, 0, 7, 16, 2]), 5) == whole.to_bytes(4, "little")
    assert [packed.width_of(n) for n in (0, 1, 2, 255, 256, 50256, 65536)] == [1, 1, 2, 8, 9, 16, 17]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=12), st.integers(1, 20), st.integers(3, 17), st.data())
def test_any_range_of_a_shard(sizes, block_ids, width, data):
    r = np.random.default_rng(len(sizes))
    docs = [(None if i % 5 == 4 else f"é{i}".encode(), r.integers(0, 1 << width, n)) for i, n in enumerate(sizes)]
    writer = packed.Writer(3, width, block_ids)
    records = [x for name, ids in docs for x in writer.add(name, ids)] + list(writer.close())
    if not docs:
        assert records == []
        return
    shard, every = packed.Shard(b"".join(x + b"\n" for x in records)), np.concatenate([ids for _, ids in docs])
    assert (shard.number, shard.count, shard.documents, shard.names()) == (3, len(every), len(docs), [n for n, _ in docs])
    assert all(shard.document(i).tolist() == ids.tolist() for i, (_, ids) in enumerate(docs))
    low = data.draw(st.integers(0, len(every)))
    high = data.draw(st.integers(low, len(every)))
    assert shard.ids(low, high).tolist() == every[low:high].tolist()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=40).map("".join), max_size=6))
def test_pieces_have_the_ids_of_the_whole_text(texts):
    ids = [np.frombuffer(x, "<u2").tolist() for x in ENCODER(pa.array(texts, pa.string()), b"\7\0").to_pylist()]
    assert ids == [[*TOKENIZER.encode(t, add_special_tokens=False).ids, 7] for t in texts]


def test_pieces_met_again_stay_remembered(monkeypatch):
    """Once too many pieces are held, only those met once go; before, common words were encoded anew each time."""
    monkeypatch.setattr(packed, "_REMEMBERED", 100)
    encoder = packed.Encoder(open(VOCABULARY, encoding="utf-8").read(), "<u2")
    learned = []
    monkeypatch.setattr(encoder, "_learn_words", lambda words, learn=encoder._learn_words: (learned.extend(words), learn(words)))
    for i in range(30):
        texts = [f"the common words, and {' '.join(f'rare{i}x{j}' for j in range(20))} end."]
        assert np.frombuffer(encoder(pa.array(texts))[0].as_buffer(), "<u2").tolist() == TOKENIZER.encode(texts[0], add_special_tokens=False).ids
    assert [learned.count(word) for word in ("common", "words,", "and", "end.")] == [1] * 4 and learned.count("rare3x5") == 1
    assert len(encoder.known) <= 130


def test_only_plain_byte_level_files_are_cut():
    plain = open(VOCABULARY, encoding="utf-8").read()
    assert packed.cut_at_spaces(plain) and not packed.cut_at_spaces(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    for change in [("normalizer", {"type": "NFC"}), ("pre_tokenizer", {"type": "ByteLevel", "add_prefix_space": True}), ("added_tokens", [{"content": "x y", "lstrip": False, "rstrip": False, "single_word": False}])]:
        assert not packed.cut_at_spaces(json.dumps({**json.loads(plain), change[0]: change[1]}))


def test_another_tokenizer_with_whole_texts(spark, tmp_path):
    file = public_tokenizers.path("word_bpe_49k.json")
    packed.write(spark.createDataFrame([(1, "Some  words, HERE"), (2, None)], "doc_id long, text string"), str(tmp_path / "w"), file, end_id=49407)
    rows = packed.read(spark, str(tmp_path / "w"), "long").orderBy("start").collect()
    ids = [np.frombuffer(r.ids, "<u4").tolist() for r in rows]
    assert ids == [[*tokenizers.Tokenizer.from_file(file).encode("Some  words, HERE", add_special_tokens=False).ids, 49407], [49407]]


def test_other_files_are_refused():
    with pytest.raises(ValueError, match="packed"):
        packed.Shard(b"x" * 100)


def _expected(docs):
    found = [(d, [*TOKENIZER.encode(t or "", add_special_tokens=False).ids, 0]) for d, t in docs]
    at, out = 0, []
    for d, ids in sorted(found, key=lambda x: (x[0] is None, x[0] or 0, len(x[1]))):
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def _digest(rows):
    return sorted(((r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in rows), key=lambda x: x[1])


def test_odd_documents_over_small_shards(spark, tmp_path):
    docs = [(3, None), (-5, ""), (9, "line\nbreak\r\n\x00end"), (11, "plain <|endoftext|> text"), (1, "naïve 漢字 🎈"), (2, "word " * 30_000),
            *[(40, "same text")] * 50, *[(None, "without id")] * 20, (7, "x" * 5000)]
    df = spark.createDataFrame([(d, t, "n", "i", "s") for d, t in docs], "doc_id long, text string, n string, ids string, shard string").repartition(4)
    path = str(tmp_path / "ids")
    packed.write(df, path, VOCABULARY, block_ids=100, shard_bytes=20_000)
    files = [f for f in glob.glob(f"{path}/files/part-*")]
    assert len(files) > 3
    assert _digest(packed.read(spark, path, "long").collect()) == _expected(docs)
    shards = {r.shard: r for r in spark.read.parquet(f"{path}/shards").collect()}
    for f in files:
        shard = packed.Shard(np.memmap(f, np.uint8, "r"))
        assert (shard.count, shard.documents) == (shards[shard.number]["ids"], shards[shard.number]["documents"]) and shard.width == 16


def test_empty_table(spark, tmp_path):
    packed.write(spark.createDataFrame([], "doc_id string, text string"), str(tmp_path / "none"), VOCABULARY)
    assert packed.read(spark, str(tmp_path / "none")).collect() == []


def test_query_equals_the_tokenizer(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    found = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in queries.QUERIES["op12_packed_ids"](spark, SF).collect())
    assert found == sorted(_expected(docs))
