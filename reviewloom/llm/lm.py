"""N-gram language model by deleted interpolation, counted and applied in blocks of whole texts.

A block is ``rows_per_block`` neighbouring rows of a stored table.  Tasks hash a block's n-grams and send each
distinct one once, in sorted arrays cut by key range; a key range adds up the counts of all blocks and answers
with counts in the order it was asked.  Blocks then meet their answers and score their own texts, so what is
shuffled are distinct n-grams per block, not tokens.

Handling of odd input: null text is empty (one token, the end); a null id trains; repeated rows count and are
scored once each; other columns are ignored; an empty table gives an empty result.  Tokens are told apart by
64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .words import U, Words, joined, mix, rows_of, slices, strings

END = mix(np.array([0xE0D], U))[0]
START = mix(np.array([0x57A], U))[0]
BUCKETS = 48
STEP = 4  # held-out probabilities are binned to a quarter of a natural-log unit for the weights
LOWEST = -160

ANSWERS = "block string, lo long, fold int, target int, counts binary, kept binary, v long, n long, n_kept long"


def token_stream(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes with one end per row, and where each row starts."""
    parts, sizes = [], []
    for a, b in slices(texts):
        w = Words(texts.slice(a, b - a))
        parts.append(np.insert(w.hash, w.first[1:], END))
        sizes.append(np.diff(w.first) + 1)
    first = np.concatenate([[0], *sizes]).cumsum()
    return np.concatenate(parts) if parts else np.zeros(0, U), first


def ngram_keys(tokens: np.ndarray, first: np.ndarray, order: int) -> list[np.ndarray]:
    """Keys of the n-grams that end at each token, shortest first; odd keys are single tokens.

    Texts are padded with a start mark, which is only ever context.
    """
    begins = np.zeros(len(tokens), bool)
    begins[first[:-1]] = True
    keys, history, at = [tokens | U(1)], tokens, tokens
    for _ in range(order - 1):
        at = np.concatenate(([START], at[:-1]))
        at[begins] = START
        history = joined(at, history)
        keys.append(history & ~U(1))
    return keys


def _ask(order: int, targets: int):
    """Distinct n-grams of each block and fold with their training counts, one row per key range."""
    def ask(batches):
        held: dict = {}
        for batch in batches:
            t = pa.Table.from_batches([batch])
            for block in t["block"].unique().to_pylist() if len(t) else []:
                part = t.filter(pa.compute.equal(t["block"], block))
                for fold in (0, 1):
                    own = part.filter(pa.compute.equal(part["fold"], fold))
                    if len(own):
                        held.setdefault((block, fold), []).append(own)
            ready = [k for k in held if k[0] != t["block"][-1].as_py()] if len(t) else []
            for k in ready:
                yield from answer_rows(*k, pa.concat_tables(held.pop(k)))
        for k, v in held.items():
            yield from answer_rows(*k, pa.concat_tables(v))

    def answer_rows(block, fold, t):
        tokens, first = token_stream(strings(t["text"]))
        keys = ngram_keys(tokens, first, order)
        trains = np.tile(np.repeat(t["trains"].to_numpy(), np.diff(first)), order)
        distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.bincount(inverse[trains], minlength=len(distinct)).astype(np.uint32)
        cut = np.searchsorted(distinct, key_cuts(targets))
        index = t["row_index"].to_numpy()
        for k in range(targets):
            a, b = cut[k], cut[k + 1]
            yield pa.RecordBatch.from_pydict({
                "block": [block], "lo": [int(index.min())], "hi": [int(index.max())], "fold": pa.array([fold], pa.int32()),
                "target": pa.array([k], pa.int32()), "keys": [distinct[a:b].tobytes()], "counts": [counts[a:b].tobytes()],
            })

    return ask


def key_cuts(targets: int) -> np.ndarray:
    return np.array([k * (1 << 64) // targets for k in range(targets)] + [(1 << 64) - 1], dtype=U)


def _answer(group: pa.Table) -> pa.Table:
    """Counts over all blocks of one key range, in the order each block asked."""
    asked = [np.frombuffer(x, U) for x in group["keys"].to_pylist()]
    counts = np.concatenate([np.frombuffer(x, np.uint32) for x in group["counts"].to_pylist()]).astype(np.int64)
    sizes = np.array([len(x) for x in asked])
    keys, inverse = np.unique(np.concatenate(asked), return_inverse=True)
    folds = np.array(group["fold"].to_pylist())
    total = np.bincount(inverse, counts, len(keys)).astype(np.int64)
    kept = np.bincount(inverse, counts * np.repeat(folds == 0, sizes), len(keys)).astype(np.int64)
    single = (keys & U(1)).astype(bool)
    ends = np.cumsum(sizes)
    ids = [inverse[b - s:b] for s, b in zip(sizes, ends)]
    n = len(sizes)
    stats = [int((single & (total > 0)).sum()), int(total[single].sum()), int(kept[single].sum())]
    return pa.table({
        "block": group["block"].to_pylist() + [None], "lo": group["lo"].to_pylist() + [None],
        "fold": pa.array(folds.tolist() + [None], pa.int32()), "target": pa.array(group["target"].to_pylist() + [None], pa.int32()),
        "counts": [narrow(total[i]) for i in ids] + [None],
        "kept": [narrow(kept[i]) if f else None for i, f in zip(ids, folds)] + [None],
        "v": [None] * n + stats[:1], "n": [None] * n + stats[1:2], "n_kept": [None] * n + stats[2:],
    }, schema=pa.schema([("block", pa.string()), ("lo", pa.int64()), ("fold", pa.int32()), ("target", pa.int32()), ("counts", pa.binary()), ("kept", pa.binary()), ("v", pa.int64()), ("n", pa.int64()), ("n_kept", pa.int64())]))


def narrow(counts: np.ndarray) -> bytes:
    """Counts in a byte each; 255 stands for an entry of the tail of eight-byte counts."""
    large = counts >= 255
    return np.where(large, 255, counts).astype(np.uint8).tobytes() + counts[large].astype("<i8").tobytes()


def widen(parts: list[bytes], sizes: list[int]) -> np.ndarray:
    out = []
    for part, n in zip(parts, sizes):
        c = np.frombuffer(part[:n], np.uint8).astype(np.int64)
        c[c == 255] = np.frombuffer(part[n:], "<i8")
        out.append(c)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _chunks(docs: pa.Table, answers: pa.Table, order: int, targets: int, which: str):
    """Rows of a block, chunk by chunk, with the counts of every token's n-grams."""
    spans = sorted({(lo, f) for lo, f in zip(answers["lo"].to_pylist(), answers["fold"].to_pylist())})
    ans = {(lo, f, k): c for lo, f, k, c in zip(*(answers[x].to_pylist() for x in ("lo", "fold", "target", which)))}
    index, folds = docs["row_index"].to_numpy(), docs["fold"].to_numpy()
    for fold in (0, 1):
        los = [lo for lo, f in spans if f == fold]
        for lo, hi in zip(los, [*los[1:], 1 << 62]):
            pick = np.flatnonzero((folds == fold) & (index >= lo) & (index < hi))
            if not len(pick):
                continue
            own = docs.take(pick)
            tokens, first = token_stream(strings(own["text"]))
            keys = ngram_keys(tokens, first, order)
            distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            cut = np.searchsorted(distinct, key_cuts(targets))
            counts = widen([ans[lo, fold, k] for k in range(targets)], np.diff(cut).tolist())
            if len(counts) != len(distinct):
                raise ValueError(f"block {docs['block'][0]} differs from what was counted")
            counts = counts[inverse].reshape(order, len(tokens))
            begins = np.zeros(len(tokens), bool)
            begins[first[:-1]] = True
            yield own, first, counts, begins


def _orders(counts: np.ndarray, begins: np.ndarray, n: int, starts: int):
    """Maximum-likelihood estimate of each order, and the count of the longest context."""
    out = [counts[0] / max(n, 1)]
    context = np.zeros(0)
    for k in range(1, len(counts)):
        context = np.concatenate(([0], counts[k - 1][:-1])).astype(float)
        # contexts that reach the start of a text: the start mark follows nothing, it is counted once a text
        context[begins] = starts
        out.append(np.divide(counts[k], context, out=np.zeros(len(context)), where=context > 0))
    return out, context


def bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, else one more than the whole part of the binary logarithm of the count."""
    return np.where(context > 0, np.minimum(np.floor(np.log2(np.maximum(context, 1))) + 1, BUCKETS - 1), 0).astype(int)


def _bin(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.maximum(np.round(np.log(np.maximum(p, 1e-300)) * STEP), LOWEST), LOWEST - 1).astype(int)


def learn_weights(histogram: pd.DataFrame, order: int, v: int, rounds: int = 60) -> np.ndarray:
    """Weights per context bucket (uniform, then order 1, 2, ...) by expectation-maximisation on held-out counts.

    A bucket without held-out tokens takes the weights of the next bucket below that has some.
    """
    weights = np.full((BUCKETS, order + 1), 1 / (order + 1))
    weights[0] = [*[1 / order] * order, 0]
    last = weights[0]
    for b in range(BUCKETS):
        h = histogram[histogram["bucket"] == b]
        if len(h):
            p = np.stack([np.full(len(h), 1 / (v + 1))] + [np.where(h[f"p{k}"] < LOWEST, 0, np.exp(h[f"p{k}"] / STEP)) for k in range(1, order + 1)])
            n, w = h["n"].to_numpy(float), np.full(order + 1, 1 / (order + 1))
            for _ in range(rounds):
                share = w[:, None] * p
                share /= share.sum(0)
                w = (share * n).sum(1) / n.sum()
            # never certain: what was not seen in held-out texts keeps a little mass
            last = (w * n.sum() + 0.5) / (n.sum() + 0.5 * (order + 1))
        weights[b] = last
    return weights


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 2, parts: int = 5,
                held_part: int = 1, weight_parts: int = 10, rows_per_block: int = 4096, stored: bool = False) -> DataFrame:
    """Score every text with a model learned from the rows whose crc32(id) mod ``parts`` is not ``held_part``.

    One in ``weight_parts`` training texts is held out once more to learn the mixture weights; the final counts
    include it.  ``docs`` must be a plain Parquet scan if ``stored``; otherwise it is written first, as blocks are
    told by file and row number.  Returns id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *(["_metadata"] if stored else []))
    if not stored:
        docs = written(docs, "lm-texts").select("id", "text", "_metadata")
    crc = F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary"))
    docs = docs.select(
        "id", "text", F.col("_metadata.row_index").alias("row_index"),
        F.concat_ws(":", "_metadata.file_path", F.floor(F.col("_metadata.row_index") / rows_per_block)).alias("block"),
        (crc % parts != held_part).alias("trains"),
        ((crc % parts != held_part) & (F.floor(crc / parts) % weight_parts == 0)).cast("int").alias("fold"),
    )
    targets = max(8, min(4096, 2 * docs.rdd.getNumPartitions()))
    asked = docs.mapInArrow(_ask(order, targets), "block string, lo long, hi long, fold int, target int, keys binary, counts binary")
    answers = written(asked.groupBy("target").applyInArrow(_answer, ANSWERS), "lm-counts")
    v, n, n_kept = (int(x or 0) for x in answers.where("block is null").agg(F.sum("v"), F.sum("n"), F.sum("n_kept")).first())
    texts = docs.agg(F.sum(F.col("trains").cast("long")), F.sum((F.col("trains") & (F.col("fold") == 0)).cast("long"))).first()
    starts, starts_kept = (int(x or 0) for x in texts)

    def bins(own, ans):
        out = []
        for _, _, counts, begins in _chunks(own, ans, order, targets, "kept"):
            p, context = _orders(counts, begins, n_kept, starts_kept)
            table = pd.DataFrame({"bucket": bucket_of(context if order > 1 else np.ones(len(p[0])))} | {f"p{k + 1}": _bin(x) for k, x in enumerate(p)})
            out.append(table.groupby(list(table.columns)).size().rename("n").reset_index())
        return pa.Table.from_pandas(pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype="int64") for c in ["bucket", *names, "n"]}), preserve_index=False).cast(histogram_schema)

    names = [f"p{k}" for k in range(1, order + 1)]
    histogram_schema = pa.schema([(c, pa.int64()) for c in ["bucket", *names, "n"]])
    asks = answers.where("block is not null")
    binned = docs.where("fold = 1").groupBy("block").cogroup(asks.where("fold = 1").groupBy("block")).applyInArrow(bins, ", ".join(f"{c} long" for c in ["bucket", *names, "n"]))
    weights = learn_weights(binned.groupBy("bucket", *names).agg(F.sum("n").alias("n")).toPandas(), order, v)

    def score(own, ans):
        out = []
        for rows, first, counts, begins in _chunks(own, ans, order, targets, "counts"):
            p, context = _orders(counts, begins, n, starts)
            w = weights[bucket_of(context if order > 1 else np.ones(len(p[0])))]
            prob = w[:, 0] / (v + 1)
            for k, x in enumerate(p):
                prob = prob + w[:, k + 1] * x
            row, size = rows_of(first), len(rows)
            base = np.log10((counts[0] + 0.5) / (n + 0.5 * (v + 1)))
            out.append(pa.table({
                "id": rows["id"], "held_out": pa.compute.invert(rows["trains"]), "n_tokens": np.diff(first),
                "n_known": np.bincount(row, counts[0] > 0, size).astype(np.int64), "train_tokens": np.full(size, n),
                "base_score": np.bincount(row, base, size), "score": np.bincount(row, np.log10(prob), size),
            }))
        return pa.concat_tables(out)

    id_type = docs.schema["id"].dataType.simpleString()
    return docs.groupBy("block").cogroup(asks.groupBy("block")).applyInArrow(
        score, f"id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    ).withColumnRenamed("id", id_col)
