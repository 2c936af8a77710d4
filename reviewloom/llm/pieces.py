"""SentencePiece encoding and decoding by shared-prefix Viterbi.

Texts are cut into marked words (a word with the blanks before it; line ends and tabs stand alone where no piece holds
them).  The distinct words of a task are sorted and walked like a trie, depth first: the forward scores of the prefix
that a word shares with the one before it are kept, and only the rest is computed.  A path has the largest sum of
piece scores; of equal paths the one whose last piece starts first is taken, as SentencePiece does for unigram models.
Characters without a piece are written as byte pieces.

The vocabulary is a SentencePiece model file, read on the driver; it is not trained here.  Normalisation must be the
identity with a blank added in front.  The character U+2581 reads back as a blank, as in SentencePiece itself.

Odd input: null and empty texts have no pieces; null ids and repeated rows keep a row each; ids outside of the
vocabulary are refused; bytes that are no UTF-8 read as U+FFFD; other columns stay.
"""

from __future__ import annotations

from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .words import raw, slices, strings

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
WORDS_KEPT = 400_000  # encoded words that a task remembers


@dataclass
class Vocabulary:
    score: dict[str, float]
    ids: dict[str, int]
    bytes_from: int  # id of the piece of byte 0
    texts: list[bytes]  # bytes that each id stands for
    unknown: float
    alone: str  # characters that no piece holds and that are cut off from words


def load(path: str = MODEL) -> Vocabulary:
    """The vocabulary of a model file with byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    if model.normalize("a  Ａ") != f"{MARK}a{MARK}{MARK}Ａ":
        raise ValueError("only models without normalisation, with a blank in front, are supported")
    n = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(n)]
    normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    if any(MARK in pieces[i].lstrip(MARK) for i in normal):
        raise ValueError("only models whose pieces hold blanks in front are supported")
    first = next(i for i in range(n) if model.is_byte(i))
    if [model.is_byte(first + k) for k in range(256)] != [True] * 256:
        raise ValueError("only models with byte pieces are supported")
    kinds = set(normal)
    texts = [pieces[i].replace(MARK, " ").encode() if i in kinds else b"" for i in range(n)]
    for k in range(256):
        texts[first + k] = bytes([k])
    used = {c for i in normal for c in pieces[i]}
    return Vocabulary(
        {pieces[i]: model.get_score(i) for i in normal}, {pieces[i]: i for i in normal}, first, texts,
        min(model.get_score(i) for i in normal) - 10, "".join(c for c in "\n\t\r" if c not in used),
    )


def piece_trie(vocabulary: Vocabulary) -> dict:
    """The pieces as nested dictionaries by character, with the score of a piece under None."""
    root: dict = {}
    for piece, score in vocabulary.score.items():
        node = root
        for c in piece:
            node = node.setdefault(c, {})
        node[None] = score
    return root


def encode_words(words: list[str], vocabulary: Vocabulary, trie: dict | None = None) -> tuple[list[list[int]], list[float]]:
    """Piece ids and score of each marked word, in the order given.

    Sorted words are a depth-first walk of their trie: by number of characters it keeps the forward score, the start of
    the last piece, and the pieces that have begun (start, node of ``trie``), and goes on behind the prefix it shares with
    the word before.
    """
    ids, unknown = vocabulary.ids, vocabulary.unknown
    root = piece_trie(vocabulary) if trie is None else trie
    order = sorted(range(len(words)), key=words.__getitem__)
    out: list = [None] * len(words)
    scores = [0.0] * len(words)
    best, start, begun = [0.0], [0], [[(0, root)]]
    before = ""
    for index in order:
        word = words[index]
        shared = 0
        for a, b in zip(before, word):
            if a != b:
                break
            shared += 1
        del best[shared + 1:], start[shared + 1:], begun[shared + 1:]
        for end in range(shared + 1, len(word) + 1):
            c = word[end - 1]
            top, since, going = None, end - 1, []
            for begin, node in begun[-1]:  # the longest piece first, which takes ties
                node = node.get(c)
                if node is not None:
                    going.append((begin, node))
                    score = node.get(None)
                    if score is not None:
                        score += best[begin]
                        if top is None or score > top:
                            top, since = score, begin
            if c not in ids and (top is None or best[end - 1] + unknown > top):
                top, since = best[end - 1] + unknown, end - 1
            going.append((end, root))
            best.append(top)
            start.append(since)
            begun.append(going)
        before = word
        path, end = [], len(word)
        while end:
            begin = start[end]
            known = ids.get(word[begin:end])
            if known is None:
                path += [vocabulary.bytes_from + b for b in reversed(word[begin:end].encode())]
            else:
                path.append(known)
            end = begin
        path.reverse()
        out[index] = path
        scores[index] = best[len(word)]
    return out, scores


class Encoder:
    """Encodes Arrow text batches; remembers words between batches."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.trie = vocabulary, piece_trie(vocabulary)
        self.alone = np.zeros(256, bool)
        self.alone[[ord(c) for c in vocabulary.alone]] = True
        self._clear()

    def _clear(self):
        self.known: dict[str, int] = {}
        self.flat, self.first, self.score = array("i"), array("q", [0]), array("d")

    def _numbers(self, words: list[str]) -> np.ndarray:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > WORDS_KEPT and self.known:
            self._clear()
            new = words
        if new:
            paths, scores = encode_words([w.replace(" ", MARK) for w in new], self.vocabulary, self.trie)
            for w, path, score in zip(new, paths, scores):
                self.known[w] = len(self.score)
                self.flat.extend(path)
                self.first.append(len(self.flat))
                self.score.append(score)
        return np.array([self.known[w] for w in words], dtype=np.int64)

    def __call__(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Piece ids and path score of each text."""
        data, off = raw(texts)
        full = np.diff(off) > 0  # an empty text gets no blank in front
        data = np.insert(data, off[:-1][full], 32)
        off = off + np.concatenate(([0], np.cumsum(full)))
        if not len(data):
            return pa.array([[]] * len(texts), pa.list_(pa.int32())), np.zeros(len(texts))
        cut = (data == 32) | self.alone[data]
        cut[1:] = (cut[1:] & ((data[1:] != 32) | (data[:-1] != 32))) | self.alone[data[:-1]]
        cut[off[:-1][full]] = True
        begin = np.flatnonzero(cut)
        words = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(np.append(begin, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
        coded = words.dictionary_encode()
        number = self._numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        # copies of the buffers, so that the arrays may grow again
        first, flat, score = np.frombuffer(self.first, np.int64).copy(), np.frombuffer(self.flat, np.int32).copy(), np.frombuffer(self.score).copy()
        size = (first[1:] - first[:-1])[number]
        ends = np.cumsum(size)
        ids = flat[np.arange(ends[-1]) - np.repeat(ends - size - first[number], size)]
        word_at = np.searchsorted(begin, off)
        heads = np.concatenate(([0], ends))[word_at]
        totals = np.concatenate(([0.0], np.cumsum(score[number])))
        return pa.ListArray.from_arrays(pa.array(heads.astype(np.int32)), pa.array(ids)), totals[word_at[1:]] - totals[word_at[:-1]]


def decode_batch(ids: pa.Array, flat: np.ndarray, first: np.ndarray) -> pa.Array:
    """Texts of lists of piece ids."""
    heads = ids.offsets.to_numpy().astype(np.int64)
    values = ids.values.to_numpy()[heads[0]:heads[-1]].astype(np.int64)
    if len(values) and (values.min() < 0 or values.max() >= len(first) - 1):
        raise ValueError("an id outside of the vocabulary")
    size = (first[1:] - first[:-1])[values]
    ends = np.cumsum(size)
    data = flat[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size - first[values], size)]
    off = np.concatenate(([0], ends))[heads - heads[0]]
    has = (off[1:] > off[:-1]) & (data[np.minimum(off[:-1], max(len(data) - 1, 0))] == 32 if len(data) else False)  # the blank in front
    keep = np.ones(len(data), bool)
    keep[off[:-1][has]] = False
    off = off - np.concatenate(([0], np.cumsum(has)))
    out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[keep]))])
    try:
        return out.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode(errors="replace") for x in out.to_pylist()])


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", ids_col: str = "pieces", score_col: str = "piece_score") -> DataFrame:
    """Add the piece ids of each whole text and the score of its path."""
    names = [c for c in docs.columns if c not in (ids_col, score_col)]
    docs = docs.select(*names)
    at = names.index(text_col)

    def run(batches):
        encoder = Encoder(vocabulary)
        for b in batches:
            t = strings(b.column(at))
            for a, e in slices(t):
                ids, score = encoder(t.slice(a, e - a))
                yield pa.RecordBatch.from_arrays([*(c.slice(a, e - a) for c in b.columns), ids, pa.array(score)], names=[*names, ids_col, score_col])

    schema = T.StructType([*docs.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField(score_col, T.DoubleType())])
    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, vocabulary: Vocabulary, ids_col: str = "pieces", text_col: str = "decoded") -> DataFrame:
    """Add the text of the piece ids of each row."""
    names = [c for c in docs.columns if c != text_col]
    docs = docs.select(*names)
    at = names.index(ids_col)
    flat = np.frombuffer(b"".join(vocabulary.texts), np.uint8)
    first = np.concatenate(([0], np.cumsum([len(t) for t in vocabulary.texts]))).astype(np.int64)

    def run(batches):
        for b in batches:
            lists = b.column(at)
            lists = lists.fill_null([]) if lists.null_count else lists
            step = 256
            for a in range(0, b.num_rows, step):
                part = lists.slice(a, step)
                yield pa.RecordBatch.from_arrays([*(c.slice(a, step) for c in b.columns), decode_batch(part, flat, first)], names=[*names, text_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(text_col, T.StringType())]))
