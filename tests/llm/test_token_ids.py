"""Simple-8b files against plain Python: words, frames, ranges, pieces, whole tables and awkward rows."""

import random
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallystream.llm import queries as Q
from tallystream.llm import token_ids as T

D = "/root/testdata/sf0.001"
SPEC = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text()


def greedy(ids):
    """The words of one block, one after another."""
    out, escapes, at = [], [], 0
    while at < len(ids):
        for s, bits in enumerate(T.BITS):
            part = ids[at : at + int(T.COUNTS[s])]
            if all(x < 1 << bits for x in part):
                out.append(s | sum(x << 4 + bits * k for k, x in enumerate(part)))
                break
        else:
            part = ids[at : at + 1]
            out.append(T.ESCAPE)
            escapes += part
        at += int(T.COUNTS[s]) if part is not None and len(part) == int(T.COUNTS[s]) else len(part)
    return out, escapes


def cases():
    rng = random.Random(1)
    yield []
    yield [0] * 5000
    yield [2**64 - 1, 0, 2**60, 2**60 - 1, 1] * 900
    for bits in (1, 3, 7, 16, 30, 59, 60, 61, 64):
        yield [rng.getrandbits(rng.randint(1, bits)) for _ in range(rng.randint(1, 9000))]
    yield [rng.choice([0, 0, 0, 1, 50_000, 2**62]) for _ in range(3 * T.BLOCK)]


@pytest.mark.parametrize("ids", list(cases()))
def test_words_and_ranges(ids):
    array = np.array(ids, np.uint64)
    words, begin, escapes, begin_escapes = T.pack(array)
    want = [greedy(ids[i : i + T.BLOCK]) for i in range(0, len(ids), T.BLOCK)]
    assert words.tolist() == [w for block, _ in want for w in block] and escapes.tolist() == [e for _, block in want for e in block]
    assert begin.tolist() == np.cumsum([0, *(len(b) for b, _ in want)])[:-1].tolist() and begin_escapes.tolist() == np.cumsum([0, *(len(e) for _, e in want)])[:-1].tolist()
    cuts = sorted(random.Random(2).randint(0, len(ids)) for _ in range(3))
    data = T.frame(array, np.diff([0, *cuts, len(ids)]), pa.array([None, 5, 5, -7]), 3, 4, 99)
    assert len(data) % 8 == 0 and data[-1:] == b"\n"
    both = list(T.frames(data + data))
    assert len(both) == 2
    for f in both:
        assert (f.file, f.number, f.ahead, f.n_ids, f.keys.to_pylist()) == (3, 4, 99, len(ids), [None, 5, 5, -7]) and f.ids().tolist() == ids
        for a, b in ((0, 1), (5, 5000), (T.BLOCK, T.BLOCK + 1), (T.BLOCK - 1, len(ids)), tuple(cuts[:2])):
            assert f.ids(min(a, len(ids)), min(b, len(ids))).tolist() == ids[a:b]


def awkward():
    rng = random.Random(3)
    space = [" ", "  ", "\n", " \n", "\t ", " ", "  ", "　 ", " ", "\u0085 ", "\r\n", "\x1c ", "​ "]
    word = ["a", "the", "It's", "we'll", "1234", "é", "Ünï", "日本", "русский", "😀", "<|endoftext|>", "--", "'s", "x" * 300, "́", "٣", "Ċ", "ª"]
    texts = ["", " ", "  ", "\n", "a", " a ", "<|endoftext|>", "\x00", "a" * 5000]
    return texts + ["".join(rng.choice(space if rng.random() < 0.5 else word) for _ in range(rng.randint(1, 60))) for _ in range(3000)]


def test_pieces_give_the_ids_of_whole_texts(monkeypatch):
    plain = Tokenizer.from_str(SPEC)
    plain.encode_special_tokens = True
    texts = awkward()
    want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(T, "CACHE", 500)
    for spec in (SPEC, Path(public_tokenizers.path("word_bpe_49k.json")).read_text()):
        encoder = T.Encoder(spec)
        if spec != SPEC:
            encoder.tokenizer.encode_special_tokens = True
            want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert encoder.by_pieces == (spec == SPEC)
        for part in (slice(0, 1000), slice(1000, None), slice(0, 0)):
            ids, counts = encoder.encode(pa.array(["ahead", *texts[part]], pa.string()).slice(1))
            assert [x.tolist() for x in np.split(ids, np.cumsum(counts))][:-1] == want[part]


def reference(rows):
    """doc_id, start, n_tokens and checksum of (doc_id, text), sorted."""
    t = Tokenizer.from_str(SPEC)
    t.encode_special_tokens = True
    out, at = [], 0
    for key, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_whole_table(spark):
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect())
    got = Q.op11_token_ids(spark, D)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and [t for _, t in got.dtypes] == ["bigint"] * 4
    assert sorted(tuple(r) for r in got.collect()) == reference(rows)


def test_files_frames_and_awkward_rows(spark):
    rows = [(i * 7 % 307 - 50, t) for i, t in enumerate(awkward()[:300])]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("_h", F.lit("x")).withColumn("_key", F.lit(1))
    got = T.stored(df.repartition(5), SPEC, "id", "text", file_bytes=4000, frame_ids=200)
    assert sorted(tuple(r) for r in got.collect()) == sorted(reference(sorted(rows)))


def test_nulls_ties_and_empty(spark):
    rows = [(None, None), (None, "a b"), (1, "same"), (1, "same"), (1, "other"), (2, None), (2, "")]
    got = T.stored(spark.createDataFrame(rows, "id long, text string"), SPEC, "id").orderBy("start").collect()
    assert [r.id for r in got] == [None, None, 1, 1, 1, 2, 2] and got[0].start == 0
    assert all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:]))
    assert sorted((r.n_tokens, r.ids_crc32) for r in got) == sorted((n, c) for _, _, n, c in reference(rows))
    assert T.stored(spark.createDataFrame([], "id string, text string"), SPEC, "id").collect() == []
    words = spark.createDataFrame([("b", "x y"), ("a", "z")], "id string, text string")
    T.write(words, path := f"{spark.conf.get('spark.checkpoint.dir')}/ids-test", SPEC, "id", end_id=None)
    back = {r.id: (r.start, r.ids) for r in T.read(spark, path, "id", "string", with_ids=True).collect()}
    t = Tokenizer.from_str(SPEC)
    assert back == {"a": (0, t.encode("z").ids), "b": (1, t.encode("x y").ids)}
