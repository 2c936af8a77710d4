"""Toxicity by a convolutional text classifier: hashed word embeddings, three filter widths, max pooling.

A word's vector is the sum of the hashed vectors of the word, of its beginnings and of its endings, so that unseen
words of a known stem are recognised.

Trained in numpy from every labelled text, whole.  The texts are dealt by id to tasks, which cut them into blocks
of about ``BLOCK_CHARS``; each block is learnt from in a task that starts from the shared weights, and what the blocks have learnt is
averaged (a word's vector over the blocks that have moved it), ``ROUNDS`` times.  A single block is learnt from once, in
more passes.  A fifth of the labelled texts, by id, is not learnt from but scored, and all of it calibrates the
thresholds per language: the lowest score from ``FLOOR`` on, on a grid of 1 / ``GRID``, at which four in five flagged
texts are labelled toxic; where there is none, that of all languages or ``FLOOR``.  Every text is scored whole, in tasks.
Only who names bounds to ``fit`` learns from a bounded sample.

Odd input: null and empty texts get the score of a text without words; a null language has the threshold of all
languages; labels without a document, without a value or repeated (the largest counts) are handled; without both
classes in the labels every score is the share of toxic labels.  Repeated rows are scored once each.
"""

from __future__ import annotations

import io
import json
import multiprocessing
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .words import U, Words, joined, slices, strings

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 16, 12, 8, (1, 2, 3)
STEMS, ENDINGS = (3, 4, 5), (3, 4)  # in bytes
PAD = BUCKETS
FLOOR, PRECISION = 0.3, 0.8
BLOCK_CHARS, ROUNDS, ROUND_EPOCHS = 8_000_000, 3, 3
SLICES = 32  # of the weights, which are averaged slice by slice
GRID = 8192  # steps of the score between which thresholds are told apart


def tokens_of(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """The words of each text as rows of a table of hashed features; its last row stands for padding."""
    docs, table, _ = _tokens(texts)
    return docs, table


def tokens_in_slices(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """The same, in portions that bound the memory needed."""
    parts = [_tokens(texts.slice(a, e - a)) for a, e in slices(texts, 1 << 20)]
    words = np.concatenate([h for _, _, h in parts] or [np.zeros(0, U)])
    _, at, number = np.unique(words, return_index=True, return_inverse=True)
    table = np.concatenate([t[:-1] for _, t, _ in parts])[at] if parts else np.zeros((0, 1 + len(STEMS) + len(ENDINGS)), np.int32)
    docs, done = [], 0
    for own, _, h in parts:
        names = number[done:done + len(h)].astype(np.int32)
        docs += [names[d] for d in own]
        done += len(h)
    return docs, np.concatenate([table, np.full((1, table.shape[1]), PAD, np.int32)])


def _tokens(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    w = Words(texts, letters_only=True)
    distinct, at, ids = np.unique(w.hash, return_index=True, return_inverse=True)
    start, size = w.start[at], (w.end - w.start)[at]
    last = len(w.data) - 1
    features = [w.hash[at]]
    for kind, widths in ((1, STEMS), (2, ENDINGS)):
        total = np.full(len(at), kind, dtype=U)
        for k in range(max(widths)):
            place = start + k if kind == 1 else start + size - 1 - k
            char = np.where(k < size, w.data[np.clip(place, 0, last)] + 1 if len(at) else 0, 0)
            total = joined(total, char.astype(U))
            if k + 1 in widths:
                features.append(total + U(k))
    table = np.stack([(f % U(BUCKETS)).astype(np.int32) for f in features], 1)
    table = np.concatenate([table, np.full((1, table.shape[1]), PAD, np.int32)])
    return (np.split(ids.astype(np.int32), w.first[1:-1]) if len(texts) else []), table, distinct


@dataclass
class Classifier:
    embed: np.ndarray  # a row of zeros stands for padding
    filters: dict[int, np.ndarray]  # width -> (width, DIM, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    share: float = 0.0
    constant: bool = False
    thresholds: dict[str | None, float] = field(default_factory=dict)

    def packed(self) -> bytes:
        """All that was learnt, as bytes."""
        out = io.BytesIO()
        facts = json.dumps([list(self.filters), float(self.out_bias), float(self.share), list(self.thresholds.items())])
        np.savez(out, *self.filters.values(), embed=self.embed, bias=self.bias, out=self.out, facts=np.array(facts))
        return out.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> Classifier:
        held = np.load(io.BytesIO(bytes(data)))
        widths, out_bias, share, thresholds = json.loads(str(held["facts"]))
        filters = {w: held[f"arr_{i}"] for i, w in enumerate(widths)}
        return cls(held["embed"], filters, held["bias"], held["out"], out_bias, share, thresholds=dict(map(tuple, thresholds)))

    def score(self, docs: list[np.ndarray], features: np.ndarray) -> np.ndarray:
        if self.constant:
            return np.full(len(docs), self.share)
        if not hasattr(self, "_table"):
            flat = np.concatenate([f.transpose(1, 0, 2).reshape(DIM, -1) for f in self.filters.values()], axis=1)
            self._table = self.embed @ flat
        seq, start, end = padded(docs, len(features) - 1)
        words = self._table[features[:, 0]]
        for k in range(1, features.shape[1]):
            words += self._table[features[:, k]]
        at, pooled = 0, []
        for w in self.filters:
            total = words[:, at:at + FILTERS][seq]
            for k in range(1, w):
                total[:-k] += words[:, at + k * FILTERS:at + (k + 1) * FILTERS][seq[k:]]
            pooled.append(segment_max(total, start, end))
            at += w * FILTERS
        hidden = np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0)
        return 1 / (1 + np.exp(-np.clip(hidden @ self.out + self.out_bias, -30, 30)))


def padded(docs: list[np.ndarray], filler: int):
    """All texts in one array with padding after each, and where the windows of each begin and end."""
    pad = np.full(max(WIDTHS), filler, np.int32)
    size = np.array([len(d) for d in docs], dtype=np.int64)
    start = np.concatenate(([0], np.cumsum(size + len(pad))))[:-1]
    seq = np.concatenate([x for d in docs for x in (d, pad)]) if docs else np.zeros(0, np.int32)
    return seq, start, start + np.maximum(size, 1)


def segment_max(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    if not len(start):
        return np.zeros((0, values.shape[1]), values.dtype)
    return np.maximum.reduceat(values, np.stack([start, end], 1).ravel(), axis=0)[::2]


def untrained(share: float, rng: np.random.Generator, init: float = 0.02) -> Classifier:
    """Random weights to start from, for this share of toxic texts."""
    f32 = np.float32
    embed = np.concatenate([rng.normal(0, init, (BUCKETS, DIM)), np.zeros((1, DIM))]).astype(f32)
    filters = {w: rng.normal(0, 0.5 / np.sqrt(w), (w, DIM, FILTERS)).astype(f32) for w in WIDTHS}
    n = FILTERS * len(WIDTHS)
    prior = float(np.clip(share, 1e-3, 1 - 1e-3))
    return Classifier(embed, filters, np.zeros(n, f32), np.abs(rng.normal(0, 0.5, n)).astype(f32), float(np.log(prior / (1 - prior))), prior)


def train(docs: list[np.ndarray], features: np.ndarray, labels: np.ndarray, weights: np.ndarray, epochs: int = 10, batch: int = 64,
          rate: float = 0.05, init: float = 0.02, dropout: float = 0.3, seed: int = 7, start: Classifier | None = None) -> Classifier:
    """Fit by Adagrad on the weighted log loss; the pass with the best loss on a tenth of the texts is kept.

    Words are left out at random while training, and of half of the words only beginnings and endings are seen, so
    that no single rare word can stand for a text.  The weights of ``start``, if given, are changed in place.
    """
    rng = np.random.default_rng(seed)
    f32 = np.float32
    model = start or untrained((labels * weights).sum() / weights.sum(), rng, init)
    embed, filters, prior = model.embed, model.filters, model.share
    slow = {k: np.full(v.shape, 1e-3, f32) for k, v in (("embed", embed[:, :1]), ("bias", model.bias), ("out", model.out), *((w, f) for w, f in filters.items()))}
    slow_bias = 1e-3
    order = rng.permutation(len(docs))
    held, order = order[:len(docs) // 10], order[len(docs) // 10:]
    best, kept = np.inf, None

    def loss() -> float:
        p = np.clip(scored(model, [docs[i] for i in held], features), 1e-6, 1 - 1e-6)
        y = labels[held]
        return float(-(weights[held] * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / max(weights[held].sum(), 1e-9))

    for _ in range(epochs):
        rng.shuffle(order)
        for at in range(0, len(order), batch):
            pick = order[at:at + batch]
            some = [docs[i] for i in pick]
            filler = len(features) - 1
            seq, start, end = padded([np.where(rng.random(len(d)) < dropout, filler, d) for d in some], filler)
            used, seq = np.unique(seq, return_inverse=True)
            parts = features[used].copy()
            parts[rng.random(len(used)) < 0.5, 0] = PAD
            vectors = embed[parts].sum(1)[seq]
            pooled, where = [], []
            for w, f in filters.items():
                total = vectors @ f[0]
                for k in range(1, w):
                    total[:-k] += vectors[k:] @ f[k]
                top = segment_max(total, start, end)
                size = end - start
                rows = np.repeat(start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                hit = total[rows] == np.repeat(top, size, axis=0)
                # first place of each maximum
                place = np.minimum.reduceat(np.where(hit, rows[:, None], len(seq)), np.cumsum(size) - size, axis=0)
                pooled.append(top)
                where.append(place)
            z = np.concatenate(pooled, axis=1) + model.bias
            hidden = np.maximum(z, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ model.out + model.out_bias, -30, 30)))
            g = (weights[pick] * (p - labels[pick]) / len(pick)).astype(f32)
            dz = np.outer(g, model.out) * (z > 0)
            d_out, d_bias, d_out_bias = hidden.T @ g, dz.sum(0), float(g.sum())
            d_embed, touched = [], []
            for j, (w, f) in enumerate(filters.items()):
                d = dz[:, j * FILTERS:(j + 1) * FILTERS]
                grad = np.zeros_like(f)
                for k in range(w):
                    ids = seq[where[j] + k]  # text, filter
                    grad[k] = np.einsum("tf,tfd->df", d, vectors[where[j] + k])
                    touched.append(ids.ravel())
                    d_embed.append((d[:, :, None] * f[k].T[None]).reshape(-1, DIM))
                slow[w] += grad ** 2
                f -= rate * grad / np.sqrt(slow[w])
            touched, d_embed = np.concatenate(touched), np.concatenate(d_embed)
            moved = np.abs(d_embed).sum(1) > 0
            touched, d_embed = parts[touched[moved]], d_embed[moved]
            ids, inverse = np.unique(touched, return_inverse=True)
            grad = np.zeros((len(ids), DIM), f32)
            np.add.at(grad, inverse.ravel(), np.repeat(d_embed, touched.shape[1], axis=0))
            grad[ids == PAD] = 0
            slow["embed"][ids] += (grad ** 2).mean(1, keepdims=True)
            embed[ids] -= rate * grad / np.sqrt(slow["embed"][ids])
            for name, grad in (("bias", d_bias), ("out", d_out)):
                slow[name] += grad ** 2
                getattr(model, name)[...] -= rate * grad / np.sqrt(slow[name])
            slow_bias += d_out_bias ** 2
            model.out_bias -= rate * d_out_bias / np.sqrt(slow_bias)
        if (now := loss() if len(held) else 0.0) < best:
            best = now
            kept = Classifier(embed.copy(), {w: f.copy() for w, f in filters.items()}, model.bias.copy(), model.out.copy(), model.out_bias, prior)
        elif now > 1.05 * best:
            break
    return kept or model


def scored(model: Classifier, docs: list[np.ndarray], features: np.ndarray, most: int = 1 << 18) -> np.ndarray:
    """Scores in portions of bounded size."""
    model.__dict__.pop("_table", None)  # the weights may have changed
    out, part, size = [np.zeros(0)], [], 0
    for d in docs:
        if part and size + len(d) > most:
            out.append(of_words(model, part, features))
            part, size = [], 0
        part.append(d)
        size += len(d)
    return np.concatenate([*out, of_words(model, part, features)] if part else out)


def of_words(model: Classifier, docs: list[np.ndarray], features: np.ndarray) -> np.ndarray:
    """Scores with the table of words cut to those that occur."""
    used, ids = np.unique(np.concatenate([*docs, [len(features) - 1]]), return_inverse=True)
    return model.score(np.split(ids[:-1], np.cumsum([len(d) for d in docs])[:-1]), features[used])


def language_thresholds(score: np.ndarray, label: np.ndarray, weight: np.ndarray, langs: list, least: int = 20, count: np.ndarray | None = None) -> dict:
    """By language and, under None, over all: the lowest score from FLOOR on that flags with the wanted precision.

    A language with fewer than ``least`` flagged calibration texts, or where no cut is that precise, takes the value
    of all languages; where no cut over all is, FLOOR holds.  Nothing is flagged (1.0) only where no calibration text
    from FLOOR on is toxic.  Where a row stands for several texts, ``count`` says for how many.
    """
    count = np.ones(len(score)) if count is None else count

    def lowest(pick: np.ndarray, otherwise: float) -> float:
        s, y, w = score[pick], label[pick], weight[pick]
        if count[pick][s >= FLOOR].sum() < least:
            return otherwise
        order = np.argsort(-s, kind="stable")
        s, right, all_ = s[order], np.cumsum((y * w)[order]), np.cumsum(w[order])
        last = np.append(s[:-1] != s[1:], True)  # of equal scores
        good = np.flatnonzero(last & (s >= FLOOR) & (right >= PRECISION * all_))
        if not len(good):
            return otherwise
        return max(FLOOR, float(s[good[-1]])) if good[-1] + 1 < (s >= FLOOR).sum() else FLOOR

    langs = np.array([x or "" for x in langs])
    high = score >= FLOOR
    every = 1.0 if count[high].sum() >= least and not label[high].any() else lowest(np.ones(len(score), bool), FLOOR)
    return {None: every} | {str(x): lowest(langs == x, every) for x in np.unique(langs) if x}


def sampled(own: DataFrame, classes: list[int], max_docs: int, max_chars: int) -> list[tuple]:
    """(id, y) of the texts to learn from, by id hash in each class: at most ``max_docs`` / 2 texts and half of the characters.

    A text that does not fit is passed over.  Characters that a class leaves over go to the next one; texts of over
    half of the characters are only taken where a class has no others, and then one.
    """
    half = room = max_chars // 2
    place = (F.col("chars") > half, F.xxhash64(F.lit("sample"), "id"), "id")
    out = []
    for y in classes:
        taken = 0
        for k, r in enumerate(own.where(F.col("y") == y).orderBy(*place).limit(max_docs // 2).select("id", "chars").collect()):
            if k == 0 or taken + r["chars"] <= room:
                out.append((r["id"], y))
                taken += r["chars"]
        room = max(half, max_chars - taken)
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        label_col: str = "toxic", parts: int = 4, held_part: int = 2, max_docs: int | None = None, max_chars: int | None = None) -> Classifier:
    """Fit on all labelled texts whose crc32(id) mod ``parts`` is not ``held_part``.

    With ``max_docs`` or ``max_chars`` it is fitted on the sample that ``sampled`` takes, in one task.
    """
    own = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    own = own.where(F.crc32(F.col("id").cast("string").cast("binary")) % parts != held_part)
    sizes = docs.select(F.col(id_col).alias("id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("chars"))
    own = written(own.join(sizes.groupBy("id").agg(F.sum("chars").alias("chars")), "id"), "labelled")
    found = {r["y"]: r for r in own.groupBy("y").agg(F.count("*").alias("n"), F.sum("chars").alias("chars")).collect()}
    toxic, clean = (found[y]["n"] if y in found else 0 for y in (1, 0))
    if not toxic or not clean:
        return Classifier(*[None] * 5, share=float(toxic > 0), constant=True, thresholds={None: FLOOR})
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).alias("lang"))
    bounded = max_docs is not None or max_chars is not None
    if bounded:
        most = (4000 if max_docs is None else max_docs, 12_000_000 if max_chars is None else max_chars)
        sample = docs.sparkSession.createDataFrame(sampled(own, sorted((0, 1), key=lambda y: found[y]["n"]), *most), own.select("id", "y").schema)
        texts = texts.join(F.broadcast(sample), "id")  # at most max_docs ids
    else:
        # those held out stay where they are; the plan is the same at any size
        texts = texts.where(F.crc32(F.col("id").cast("string").cast("binary")) % parts != held_part).join(own.select("id", "y").hint("merge"), "id")
    texts = texts.select(F.col("id").cast("string").alias("id"), "text", F.col("lang").cast("string").alias("lang"), F.col("y").cast("int").alias("y"))
    if not bounded:
        return fit_blocks(texts, toxic / (toxic + clean), sum(r["chars"] for r in found.values()) <= BLOCK_CHARS)

    def learn(batches):
        rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: r[:2])
        weights = apart(lambda: learnt(rows, toxic, clean).packed())
        yield pa.RecordBatch.from_arrays([pa.array([weights], pa.binary())], names=["model"])

    # the bounded sample is learnt from in one task; the driver gets the weights
    return Classifier.unpacked(texts.repartition(1).mapInArrow(learn, "model binary").first()[0])


def fit_blocks(texts: DataFrame, share: float, single: bool) -> Classifier:
    """A model of all (id, text, lang, y) rows, learnt block by block and averaged; a fifth of the ids calibrates.

    The rows are written once; each round reads the files and cuts what a task reads into blocks.
    """
    texts = written(texts.withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "id"), F.lit(5))), "toxicity-texts")
    model = untrained(share, np.random.default_rng(7))
    use = texts.where("part > 0").select("id", "text", "y")
    use = use.coalesce(1) if single else use
    for k in range(1 if single else ROUNDS):
        moved = use.mapInArrow(_block_learner(model, k, 10 if single else ROUND_EPOCHS), "slice int, moved binary")
        means = moved.repartition(SLICES // 4, "slice").mapInArrow(_averaged, "slice int, moved binary").collect()
        model = added(model, {r["slice"]: r["moved"] for r in means})
    model.thresholds = calibrated(score(texts.where("part = 0").select("text", "lang", "y"), model))
    return model


def _block_learner(model: Classifier, number: int, epochs: int):
    """A function that learns from the rows of a block and gives how far that moves each slice of the weights."""
    start, sizes = model.packed(), [x.nbytes for x in _sliced(model)]

    def run(batches):
        for table in _blocks(batches):
            data, ends = apart(lambda: work(table)), np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(sizes)), pa.int32()), pa.array([data[e - n:e] for e, n in zip(ends, sizes)], pa.binary())], names=["slice", "moved"])

    def work(table: pa.Table) -> bytes:
        table = table.sort_by([("id", "ascending"), ("text", "ascending")])
        own, before = Classifier.unpacked(start), Classifier.unpacked(start)
        docs, features = tokens_in_slices(strings(table.column("text")))
        y = table.column("y").to_numpy().astype(np.float32)
        after = train(docs, features, y, np.ones(len(y), np.float32), epochs=epochs, rate=0.05 / (number + 1), seed=number + 7, start=own)
        return b"".join((a - b).astype(np.float32).tobytes() for a, b in zip(_sliced(after), _sliced(before)))

    return run


def _blocks(batches):
    """The rows in tables of about ``BLOCK_CHARS`` bytes of text, every row in one."""
    held, size = [], 0
    for b in batches:
        for a, e in slices(strings(b.column(1)), max(1, BLOCK_CHARS // 8)):
            held.append(b.slice(a, e - a))
            size += held[-1].column(1).nbytes
            if size >= BLOCK_CHARS:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _sliced(model: Classifier) -> list[np.ndarray]:
    """All weights as slices: rows of word vectors, and at the end everything else."""
    dense = [*(f.ravel() for f in model.filters.values()), model.bias, model.out, [model.out_bias]]
    return [*np.array_split(model.embed, SLICES), np.concatenate(dense).astype(np.float32)]


def _averaged(batches):
    """Means over the blocks per slice: of a word vector over the blocks that have moved it, of the rest over all."""
    total, n = {}, {}
    for b in batches:
        for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            moved = np.frombuffer(data, np.float32).reshape(-1, DIM if k < SLICES else 1)
            total[k] = total.get(k, 0) + moved.astype(float)
            n[k] = n.get(k, 0) + ((moved != 0).any(1, keepdims=True) if k < SLICES else 1)
    out = [(total[k] / np.maximum(n[k], 1)).astype(np.float32).tobytes() for k in total]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(out, pa.binary())], names=["slice", "moved"])


def added(model: Classifier, moved: dict[int, bytes]) -> Classifier:
    """The model with each slice of its weights moved so far."""
    now = [x + np.frombuffer(moved[k], np.float32).reshape(x.shape) if k in moved else x for k, x in enumerate(_sliced(model))]
    dense, filters, at = now[-1], {}, 0
    for w, f in model.filters.items():
        filters[w] = dense[at:at + f.size].reshape(f.shape)
        at += f.size
    n = len(model.bias)
    return Classifier(np.concatenate(now[:-1]), filters, dense[at:at + n], dense[at + n:at + 2 * n], float(dense[-1]), model.share)


def calibrated(scores: DataFrame) -> dict:
    """Thresholds from all (lang, y, score) rows, counted in tasks per language, label and step of the score."""
    steps = scores.where(F.col("score") >= FLOOR).groupBy("lang", "y", F.floor(F.col("score") * GRID).alias("step")).agg(F.min("score").alias("low"), F.count("*").alias("n"))
    rows = steps.collect()
    low = {}
    for r in rows:  # a step is flagged as a whole, whatever its languages
        low[r["step"]] = min(r["low"], low.get(r["step"], 1.0))
    n = np.array([r["n"] for r in rows], float)
    return language_thresholds(np.array([low[r["step"]] for r in rows], float), np.array([r["y"] for r in rows], int), n, [r["lang"] for r in rows], count=n)


def apart(work) -> bytes:
    """The bytes that ``work`` gives, from a process of its own: the memory it takes does not stay with Spark's worker."""
    context = multiprocessing.get_context("fork")
    receive, send = context.Pipe(duplex=False)
    process = context.Process(target=lambda: send.send_bytes(work()))
    process.start()
    send.close()  # so that a process that dies is the end of the file here
    try:
        return receive.recv_bytes()
    finally:
        process.join()


def learnt(rows: list[tuple], toxic: int, clean: int) -> Classifier:
    """A model of (id, text, lang, y) rows, weighted back to so many toxic and clean texts; a fifth of them calibrates."""
    docs, features = tokens_in_slices(strings(pa.array([r[1] for r in rows], pa.large_string())))
    y, langs = np.array([r[3] for r in rows], np.float32), [r[2] for r in rows]
    seen = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    weight = np.where(y == 1, toxic / seen[1], clean / seen[0])
    weight = (weight / weight.mean()).astype(np.float32)
    part = np.random.default_rng(11).random(len(docs)) < 0.2
    use, cal = np.flatnonzero(~part), np.flatnonzero(part)
    model = train([docs[i] for i in use], features, y[use], weight[use])
    model.thresholds = language_thresholds(scored(model, [docs[i] for i in cal], features), y[cal], weight[cal], [langs[i] for i in cal])
    model.__dict__.pop("_table", None)
    return model


def score(docs: DataFrame, model: Classifier, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Add the toxicity score (0 to 1) of each whole text, in place of a column of this name; all other columns stay."""
    docs = docs.drop(score_col) if score_col != text_col else docs
    schema = docs.withColumn(score_col, F.lit(0.0)).schema
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            t = strings(b.column(at))
            parts = [model.score(*tokens_of(t.slice(a, e - a))) for a, e in slices(t)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate([np.zeros(0), *parts]), pa.float64())], names=[*b.schema.names, score_col])

    return docs.mapInArrow(run, schema)


def flagged(model: Classifier, score_col: str = "score", lang_col: str = "lang"):
    """True where a score reaches the threshold of the row's language."""
    threshold = F.lit(model.thresholds.get(None, FLOOR))
    for lang, value in model.thresholds.items():
        if lang is not None:
            threshold = F.when(F.col(lang_col) == lang, value).otherwise(threshold)
    return F.col(score_col) >= threshold
