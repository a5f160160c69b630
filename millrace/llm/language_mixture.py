"""Language identification by multilingual mixture inference.

Each language has a multinomial over letter trigrams (each letter with its neighbours,
word borders included). A document is a mixture: its words are drawn from languages in
unknown proportions, found by expectation-maximisation over the words' likelihoods. The
set of languages is the one of greatest penalised likelihood (BIC) along the nested sets
that the full fit's proportions order; where one language alone already beats what any
larger set could reach, the others aren't fitted.

Defined cases: a text that is null or holds no letter gets ``und`` and score 0, and so do
all texts when nothing labelled could be learned from (empty table); ties go to the language
that sorts first; very long texts are read in blocks, whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import parts_of, texts_of

BUCKETS = 1 << 17
BLOCK = 1 << 20
_LETTER: np.ndarray | None = None


def _letters(codes: np.ndarray) -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x30000)), bool, 0x30000)
    return _LETTER[np.minimum(codes, 0x2FFFF)]


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram around each letter, and the places where words begin among them."""
    codes = np.frombuffer(f" {text} ".lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_letters(codes), codes, 0).astype(np.uint32)
    at = np.flatnonzero(codes)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = codes[at - 1] * np.uint32(0x85EBCA6B) ^ codes[at] * np.uint32(0xC2B2AE35) ^ codes[at + 1] * np.uint32(0x27D4EB2F)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    return (h & np.uint32(BUCKETS - 1)).astype(np.int64), np.flatnonzero(codes[at - 1] == 0)


def blocks_of(text: str) -> Iterator[str]:
    """The whole text in blocks of about ``BLOCK`` characters, cut at blanks where there are any."""
    start = 0
    while len(text) - start > BLOCK:
        cut = text.rfind(" ", start, start + BLOCK)
        cut = cut if cut > start else start + BLOCK
        yield text[start:cut]
        start = cut
    yield text[start:]


@dataclass(frozen=True)
class MixtureModel:
    """``log_p``: log probability of each trigram bucket in each language, buckets x languages."""

    langs: list[str]
    log_p: np.ndarray
    penalty: float = 3.0

    def word_scores(self, text: str) -> np.ndarray:
        parts = []
        for block in blocks_of(text):
            ids, starts = trigrams(block)
            if len(ids):
                parts.append(np.add.reduceat(self.log_p[ids], starts, axis=0))
        return np.concatenate(parts) if parts else np.zeros((0, len(self.langs)))

    def infer(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """Mixture proportions of each document (zero outside the chosen set) from its words' scores."""
        n = np.array([len(s) for s in scores])
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        ll = np.concatenate(scores).astype(np.float64)
        top = ll.max(axis=1, keepdims=True)
        like = np.exp(np.maximum(ll - top, -60))
        base = np.add.reduceat(top[:, 0], starts)
        owner = np.repeat(np.arange(len(n)), n)
        full, reach = _em(like, owner, starts, n, np.full((len(n), len(self.langs)), 1 / len(self.langs)))
        fee = self.penalty * 0.5 * np.log(n + 1.0)
        order = np.argsort(-full, axis=1, kind="stable")
        one = np.add.reduceat(ll, starts, axis=0)
        best = one.argmax(axis=1)
        value = one[np.arange(len(n)), best] - base
        chosen = np.zeros_like(full)
        chosen[np.arange(len(n)), best] = 1
        # sets of 2 and more: only for documents where the full fit's likelihood leaves room for the fee
        for k in range(2, len(self.langs) + 1):
            room = np.flatnonzero(reach - fee * (k - 1) > value)
            if not len(room):
                break
            rows = np.concatenate([np.arange(starts[d], starts[d] + n[d]) for d in room])
            pi = np.zeros((len(room), len(self.langs)))
            np.put_along_axis(pi, order[room, :k], 1 / k, axis=1)
            m = n[room]
            pi, got = _em(like[rows], np.repeat(np.arange(len(room)), m), np.concatenate([[0], np.cumsum(m)[:-1]]), m, pi)
            better = got - fee[room] * (k - 1) > value[room]
            value[room[better]] = (got - fee[room] * (k - 1))[better]
            chosen[room[better]] = pi[better]
        return list(chosen)


def _em(like: np.ndarray, owner: np.ndarray, starts: np.ndarray, n: np.ndarray, pi: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """EM for the proportions of many documents at once; also the log-likelihood reached."""
    for i in range(rounds):
        joint = like * pi[owner]
        total = joint.sum(axis=1)
        new = np.add.reduceat(joint / total[:, None], starts, axis=0) / n[:, None]
        moved = np.abs(new - pi).max()
        pi = new
        if moved < 1e-3:
            break
    return pi, np.add.reduceat(np.log((like * pi[owner]).sum(axis=1)), starts)


def fit(train: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", max_docs: int = 3000, add: float = 0.1) -> MixtureModel:
    """Fit on at most about ``max_docs`` labelled documents of each language (the bounded sample), by hash of the key and text.

    Executors count trigrams of whole texts; the driver gets languages x buckets sums.
    """
    train = train.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.col(key).alias("_m_key")).where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return MixtureModel([], np.zeros((BUCKETS, 0), np.float32))
    share = F.lit(0.0)
    for k in langs:
        share = F.when(F.col("lang") == k, F.lit(min(1.0, max_docs / sizes[k]))).otherwise(share)
    drawn = train.where(F.pmod(F.xxhash64("_m_key", "text"), F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text")
    index = {k: i for i, k in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), BUCKETS), np.int64)
        for b in parts_of(batches):
            for k, t in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True):
                for block in blocks_of(t):
                    total[index[k]] += np.bincount(trigrams(block)[0], minlength=BUCKETS)
        k, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[k, bucket])], ["k", "bucket", "n"])

    got = drawn.mapInArrow(count, "k int, bucket int, n bigint").groupBy("k", "bucket").agg(F.sum("n").alias("n")).toArrow()
    total = np.full((BUCKETS, len(langs)), 0.0)
    total[got["bucket"].to_numpy(), got["k"].to_numpy()] = got["n"].to_numpy()
    seen = int((total.sum(axis=1) > 0).sum())
    p = (total + add) / (total.sum(axis=0) + add * (seen + 1))
    return MixtureModel(langs, np.log(p).astype(np.float32))


def identify(df: DataFrame, model: MixtureModel, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``lang_pred``, ``score`` (its proportion), ``langs`` (the chosen set) and ``shares`` to the ``keep`` columns.

    Only texts go to Python and only results come back; the other columns stay with Spark.
    """
    given = [c for c in df.columns if c != text] if keep is None else keep
    results = ["lang_pred", "score", "langs", "shares"]
    keep = [c for c in given if c not in results]  # an input column of a result's name gives way
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double,langs:array<string>,shares:array<double>>")
    def mixture(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for b in batches:
            rows = [("und", 0.0, [], [])] * len(b)
            at, scores, size = [], [], 0

            def flush() -> None:
                for i, pi in zip(at, m.infer(scores) if at else [], strict=True):
                    order = [int(j) for j in np.argsort(-pi, kind="stable") if pi[j] > 0]
                    rows[i] = (m.langs[order[0]], float(min(1.0, pi[order[0]])), [m.langs[j] for j in order], [float(pi[j]) for j in order])
                at.clear()
                scores.clear()

            for i, t in enumerate(texts_of(b)):
                if t and m.langs and len(s := m.word_scores(t)):
                    at.append(i)
                    scores.append(s)
                    size += len(s)
                    if size > 100_000:
                        flush()
                        size = 0
            flush()
            pred, score, langs, shares = (list(x) for x in zip(*rows, strict=True)) if rows else ([], [], [], [])
            yield pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(langs, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))], results)

    # not deterministic for the planner only: else a filter on a result would run the function once more
    return df.withColumn("_m_found", mixture.asNondeterministic()(F.col(text))).select(*keep, *[F.col(f"_m_found.{c}").alias(c) for c in results])


def rejects(share: float = 0.5) -> Column:
    """A document is rejected if it has no language or none with ``share`` of its words."""
    return (F.col("lang_pred") == "und") | (F.col("score") < share)
