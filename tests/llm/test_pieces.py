import random

import pyarrow as pa
import pytest

from reviewloom.llm import pieces
from reviewloom.llm.queries import QUERIES

spm = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load()


@pytest.fixture(scope="module")
def unigram():
    """The library's own Viterbi over the same pieces and scores; runs of blanks have no usable score there."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    with open(pieces.MODEL, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = proto.TrainerSpec.UNIGRAM
    for p in m.pieces:
        if p.score < -1e8:
            p.type = proto.ModelProto.SentencePiece.UNUSED
    out = spm.SentencePieceProcessor()
    out.LoadFromSerializedProto(m.SerializeToString())
    return out


def best_by_trial(word, v):
    """The largest sum over all cuts."""
    top = [0.0] + [None] * len(word)
    for end in range(1, len(word) + 1):
        options = [top[a] + v.score[word[a:end]] for a in range(end) if word[a:end] in v.score]
        if word[end - 1] not in v.ids:
            options.append(top[end - 1] + v.unknown)
        top[end] = max(options)
    return top[-1]


def test_words_equal_the_library(spark, vocabulary, unigram):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    words = sorted({w for t in texts for w in t.split()} | {"Hello", "straße", "naïve", "x" * 60})
    words = [w for w in words if pieces.MARK not in w]
    paths, scores = pieces.encode_words([pieces.MARK + w for w in words], vocabulary)
    plain = 0
    for w, path, score in zip(words, paths, scores):
        want = unigram.encode(w)
        if score > -1e8 and not any(vocabulary.bytes_from <= x < vocabulary.bytes_from + 256 for x in want):
            assert path == want, w
            plain += 1
    assert plain > 0.9 * len(words)
    for w, score in random.Random(1).sample(list(zip(words, scores)), 400):
        assert score == best_by_trial(pieces.MARK + w, vocabulary)


def test_whole_table(spark):
    rows = QUERIES["op5_shared_prefix_viterbi"](spark, "/root/testdata/sf0.01").collect()
    library = spm.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert r.same and r.n_pieces == len(r.pieces) and library.decode(r.pieces) == texts[r.doc_id]


def test_order_of_words_does_not_matter(vocabulary):
    rng = random.Random(4)
    words = [pieces.MARK + "".join(rng.choice("abcdeß漢\n ") for _ in range(rng.randrange(12))).replace(" ", pieces.MARK) for _ in range(500)] + [""]
    each = [pieces.encode_words([w], vocabulary) for w in words]
    paths, scores = pieces.encode_words(words, vocabulary)
    assert paths == [p[0] for p, _ in each] and scores == [s[0] for _, s in each]


def test_odd_rows(spark, vocabulary, monkeypatch):
    monkeypatch.setattr(pieces, "WORDS_KEPT", 5)  # forget words often
    texts = [None, "", " ", "   ", "\n", "\n\n a  b\t", "a" * 30_000, "▁x y", "\U0001f600 漢字\x00", " lead", "trail ", "x\r\ny", "n" + "\n" * 50, " ".join(f"w{i}" for i in range(3000))]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] * 2 + [(None, "null id", 1)], "doc_id long, text string, score int")
    got = pieces.decode(pieces.encode(df, vocabulary), vocabulary).collect()
    assert len(got) == 2 * len(texts) + 1
    library = spm.SentencePieceProcessor(model_file=pieces.MODEL)
    for r in got:
        assert r.decoded == (r.text or "").replace(pieces.MARK, " ") == library.decode(r.pieces)
        assert (r.pieces == []) == (not r.text)
    assert pieces.encode(df.limit(0), vocabulary).collect() == []


def test_any_ids_decode_like_the_library(vocabulary):
    import numpy as np

    rng = random.Random(9)
    lists = [[rng.randrange(3, 32_000) for _ in range(rng.randrange(9))] for _ in range(300)] + [[3 + 0xC3], [3 + 0xC3, 3 + 0xA9], []]
    flat = np.frombuffer(b"".join(vocabulary.texts), np.uint8)
    first = np.concatenate(([0], np.cumsum([len(t) for t in vocabulary.texts]))).astype(np.int64)
    library = spm.SentencePieceProcessor(model_file=pieces.MODEL)
    for ids in lists:
        assert pieces.decode_batch(pa.array([ids], pa.list_(pa.int32())), flat, first)[0].as_py() == library.decode(ids)
    with pytest.raises(ValueError):
        pieces.decode_batch(pa.array([[40_000]], pa.list_(pa.int32())), flat, first)
