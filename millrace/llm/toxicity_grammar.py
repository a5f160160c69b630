"""Toxicity by a weighted finite-state pattern grammar.

Words are mapped to symbols (insult, threat, target, negation, reporting verb, quote,
clause end, other). Small weighted transducers over these symbols, one for each of
negation, reported speech, target and threat, are composed into one machine whose arcs
carry the product of the parts' weights. It runs over each clause and a clause counts
only where an insult or threat is matched in it: a negated or reported one counts for
less, one aimed at a target for more. Insult words and stems are learned from labelled
documents as weighted log odds; a logistic curve over clause scores gives the result.

Defined cases: null and empty texts get the score of a text without any match; repeated
rows score alike; without labelled rows every score is the prior 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import WordHash, lower_words_of, texts_of, window_hashes

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, END = range(8)

# Closed word classes of the four languages (fixed values).
NEGATIONS = "not no never none nobody isn't aren't don't nicht kein keine keinen nie niemals ne pas jamais aucun aucune no nunca jamás ningún ninguna nadie".split()
REPORTS = "said says say told tells called calls wrote writes claimed quoted sagte sagt sagen nannte schrieb behauptete dit disait disent appelé écrit affirmé dijo dice dicen llamó escribió".split()
TARGETS = "you your you're yourself u he she they him her them du dich dir dein deine ihr euch sie tu te toi ton ta vous votre ils elles tú ti tu usted ustedes vosotros ellos ellas".split()
THREATS = "kill hurt destroy beat stab shoot burn töten schlagen vernichten umbringen tuer frapper détruire brûler matar golpear destruir quemar".split()
_TARGET_SET = frozenset(TARGETS)
QUOTES = '"“”„«»'
ENDS = ".!?;:"
STRIP = ENDS + ",()[]{}'’…" + QUOTES


@dataclass(frozen=True)
class Transducer:
    """Arcs (state, symbol) -> (state, weight); a missing arc keeps the state with weight 1. Start is state 0."""

    states: int
    arcs: dict[tuple[int, int], tuple[int, float]] = field(default_factory=dict)

    def step(self, state: int, symbol: int) -> tuple[int, float]:
        return self.arcs.get((state, symbol), (state, 1.0))

    def compose(self, other: Transducer) -> Transducer:
        """Both read the same symbols; weights multiply. Only pairs reached from the start become states."""
        index, todo, arcs = {(0, 0): 0}, [(0, 0)], {}
        while todo:
            a, b = todo.pop()
            for s in range(8):
                (x, u), (y, v) = self.step(a, s), other.step(b, s)
                if (x, y) not in index:
                    index[x, y] = len(index)
                    todo.append((x, y))
                arcs[index[a, b], s] = (index[x, y], u * v)
        return Transducer(len(index), arcs)

    def tables(self) -> tuple[list[list[int]], list[list[float]]]:
        steps = {(q, s): self.step(q, s) for q, s in product(range(self.states), range(8))}
        return [[steps[q, s][0] for s in range(8)] for q in range(self.states)], [[steps[q, s][1] for s in range(8)] for q in range(self.states)]


def grammar(negated: float = 0.25, reported: float = 0.5, aimed: float = 1.5, scope: int = 3, threat_without_target: float = 0.0) -> Transducer:
    """Composition of the four transducers. Each forgets at a clause's end, reported speech at the closing quote too."""
    neg = Transducer(scope + 1)
    for q in range(scope + 1):
        neg.arcs.update({(q, OTHER): (max(0, q - 1), 1.0), (q, TARGET): (max(0, q - 1), 1.0), (q, NEGATION): (scope, 1.0), (q, END): (0, 1.0)})
        if q:
            neg.arcs.update({(q, s): (max(0, q - 1), negated) for s in (INSULT, THREAT)})
    said = Transducer(3)
    for q in range(3):
        said.arcs.update({(q, REPORT): (max(q, 1), 1.0), (q, QUOTE): (0 if q == 2 else 2, 1.0), (q, END): (2 if q == 2 else 0, 1.0)})
        if q:
            said.arcs.update({(q, s): (q, reported) for s in (INSULT, THREAT)})
    aim = Transducer(2, {(0, TARGET): (1, 1.0), (1, END): (0, 1.0), (1, INSULT): (1, aimed)})
    threat = Transducer(2, {(0, TARGET): (1, 1.0), (1, END): (0, 1.0), (0, THREAT): (0, threat_without_target), (1, THREAT): (1, 1.0)})
    return neg.compose(said).compose(aim).compose(threat)


def aimed_words(text: str) -> set[str]:
    """Words that a clause of the text has after a target, marked with ``>``."""
    out: set[str] = set()
    for line in text.lower().split("\n"):
        aimed = False
        for token in line.split():
            w = token.strip(STRIP)
            if aimed and w:
                out.add(">" + w)
            aimed = (aimed or w in _TARGET_SET) and not any(e in token[-2:] for e in ENDS)
    return out


def features_of(text: str, lo: int, hi: int) -> Counter[str]:
    """Distinct words of a text, and stems of ``lo`` to ``hi`` letters (marked with ``*``) with how many of those words have them; then words aimed at a target."""
    words = {w.strip(STRIP) for w in set(text.lower().split())}
    out = Counter(words)
    for w in words:
        out.update(w[:k] + "*" for k in range(lo, min(hi, len(w) - 1) + 1))
    out.update(aimed_words(text))
    del out[""]
    return out


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    stem: tuple[int, int] = (4, 8)
    threat_weight: float = 4.0
    curve: tuple[float, ...] = (-30.0, 0.0, 0.0, 0.0)
    machine: Transducer = field(default_factory=grammar)
    threats: dict[str, float] = field(default_factory=dict)
    most: int = 100_000  # words remembered between texts

    def __post_init__(self) -> None:
        self.next, self.out = self.machine.tables()
        self.classes = dict.fromkeys(THREATS, THREAT) | dict.fromkeys(TARGETS, TARGET) | dict.fromkeys(NEGATIONS, NEGATION) | dict.fromkeys(REPORTS, REPORT)
        self.known: dict[str, int] = {}
        self.symbols: list[list[tuple[int, float]]] = [[]]

    def _look_up(self, token: str) -> int:
        """Number of the token's symbol sequence; 0: only ``OTHER``."""
        word = token.strip(STRIP)
        seq: list[tuple[int, float]] = [(QUOTE, 0.0)] if token[0] in QUOTES else []
        w = max([self.weights.get(word, 0.0), *(self.weights.get(word[:k] + "*", 0.0) for k in range(self.stem[0], min(self.stem[1], len(word) - 1) + 1))])
        if w > 0:
            seq.append((INSULT, w))
        elif t := self.threats.get(word):
            seq.append((THREAT, t))
        elif (c := self.classes.get(word, OTHER)) != OTHER:
            seq.append((c, self.threat_weight if c == THREAT else 0.0))
        elif word:
            seq.append((OTHER, 0.0))
        if len(token) > 1 and any(q in token[-2:] for q in QUOTES):
            seq.append((QUOTE, 0.0))
        if any(e in token[-2:] for e in ENDS):
            seq.append((END, 0.0))
        n = 0
        if seq != [(OTHER, 0.0)]:
            self.symbols.append(seq)
            n = len(self.symbols) - 1
        self.known[token] = n
        return n

    def clauses(self, text: str | None) -> list[float]:
        """Scores of the clauses in which an insult or a threat is matched."""
        if len(self.known) > self.most:  # between texts only, so that a text's numbers hold to its end
            self.known.clear()
            del self.symbols[1:]
        tokens = text.lower().replace("\n", " ; ").split() if text else []
        known, look, table = self.known, self._look_up, self.symbols
        codes = [known[t] if t in known else look(t) for t in tokens]
        if not any(s in (INSULT, THREAT) for c in set(codes) for s, _ in table[c]):
            return []
        found, state, clause = [], 0, 0.0
        for c in codes:
            for s, w in table[c] or ((OTHER, 0.0),):
                if w:
                    clause += w * self.out[state][s]
                state = self.next[state][s]
                if s == END and clause:
                    found.append(clause)
                    clause = 0.0
        return found + [clause] * bool(clause)

    def document(self, text: str | None) -> np.ndarray:
        """1, greatest clause score, log of the clauses' sum, log of their number."""
        c = self.clauses(text)
        return np.array([1.0, max(c, default=0.0), np.log1p(sum(c)), np.log1p(len(c))])

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.document(text) @ np.array(self.curve), -30, 30))))


@F.pandas_udf(LongType())
def _sketch(text: pd.Series) -> pd.Series:
    """Minimum over the hashes of a text's word triples."""
    words = WordHash()
    return text.map(lambda t: int(window_hashes(words.array(lower_words_of(t)), 3).min(initial=2**64 - 1)) >> 1).astype("int64")


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Ridge logistic regression by Newton's method."""
    b = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * w[:, None]).T @ x + ridge * np.eye(len(b)), x.T @ (y - p) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-6:
            break
    return b


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", label: str = "toxic", max_toxic: int = 3000, max_clean: int = 4000, min_share: float = 0.03, min_docs: int = 4, min_log_odds: float = 3.0, min_sure: float = 1.7) -> ToxicityModel:
    """Learn insult words and stems, and the curve, from a bounded sample of labelled rows: those whose log odds, and their lower confidence bound, are high.

    The sample holds about ``max_toxic`` and ``max_clean`` documents at most, drawn by hash of
    the key; its keys are the only table broadcast. Executors count features and score the
    sample; the driver gets features that ``min_share`` of the toxic sample hold, and four
    numbers for each sampled document.
    """
    marked = labels.select(F.col(key).alias("_m_key"), F.col(label).cast("int").alias("_m_y")).where(F.col("_m_key").isNotNull() & F.col("_m_y").isin(0, 1)).groupBy("_m_key").agg(F.max("_m_y").alias("_m_y"))
    n = {r["_m_y"]: r["n"] for r in marked.groupBy("_m_y").agg(F.count("*").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return ToxicityModel({})
    share = F.when(F.col("_m_y") == 1, min(1.0, max_toxic / n[1])).otherwise(min(1.0, max_clean / n[0]))
    drawn = marked.where(F.pmod(F.xxhash64("_m_key"), F.lit(1 << 20)) < share * (1 << 20))
    sample = docs.select(F.col(key).alias("_m_key"), F.col(text).alias("_m_text")).where(F.col("_m_text").isNotNull()).join(F.broadcast(drawn), "_m_key").select("_m_text", "_m_y")
    sample = sample.withColumn("_m_sketch", _sketch("_m_text")).dropDuplicates(["_m_sketch", "_m_y"]).drop("_m_sketch")
    lo, hi = ToxicityModel.stem

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, forms = (Counter(), Counter()), Counter()
        rows = [0, 0]
        for b in batches:
            for t, y in zip(texts_of(b.column(0)), b.column(1).to_pylist(), strict=True):
                found = features_of(t, lo, hi)
                both[y].update(found.keys())
                if y:
                    forms.update(found)
                rows[y] += 1
        both[1][""], both[0][""] = rows[1], rows[0]
        names = list(both[0].keys() | both[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names), *(pa.array([x[f] for f in names], pa.int64()) for x in (both[1], both[0], forms))], ["f", "t", "c", "w"])

    sums = sample.mapInArrow(count, "f string, t bigint, c bigint, w bigint").groupBy("f").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.sum("w").alias("w"))
    enough = F.col("t") >= max(min_docs, int(min_share * min(n[1], max_toxic)))
    got = {f: (t, c, w) for f, t, c, w in sums.where((F.col("f") == "") | enough | ((F.col("t") > 1) & (F.col("c") == 0) & (F.col("w") >= 3 * F.col("t")))).collect()}
    toxic, clean, _ = got.pop("", (0, 0, 0))
    # a stem that many forms share says more than its few documents
    got = {f: (max(t, w if c == 0 and w >= 3 * t else 0), c) for f, (t, c, w) in got.items()}
    odds = {f: float(np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1))) for f, (t, c) in got.items()}
    sure = {f: odds[f] - 1.64 * float(np.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))) for f, (t, c) in got.items()}
    strong = {f: w for f, w in odds.items() if w >= min_log_odds and sure[f] >= min_sure}
    # a word that is toxic only after a target is a threat, one that is toxic anywhere an insult
    model = ToxicityModel({f: w for f, w in strong.items() if f[0] != ">"}, threats={f[1:]: w for f, w in strong.items() if f[0] == ">" and f[1:] not in strong})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([shared.value.document(t) for t in texts_of(b.column(0))]).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, i]) for i in range(4)), b.column(1)], ["a", "b", "c", "d", "y"])

    seen = sample.mapInArrow(measure, "a double, b double, c double, d double, y int").toArrow()
    x, y = np.column_stack([seen[i].to_numpy() for i in range(4)]), seen["y"].to_numpy()
    if len(y):
        model.curve = tuple(float(v) for v in _logistic(x, y))
    return model


def score(df: DataFrame, model: ToxicityModel, *, text: str = "text", keep: list[str] | None = None, threshold: float = 0.3) -> DataFrame:
    """Add ``score`` (0 to 1), ``predicted`` and ``n_clauses`` (clauses matched) to the ``keep`` columns."""
    given = [c for c in df.columns if c != text] if keep is None else keep
    results = ["score", "predicted", "n_clauses"]
    keep = [c for c in given if c not in results]  # an input column of a result's name gives way
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<score:double,predicted:int,n_clauses:bigint>")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for b in batches:
            x = np.array([m.document(t) for t in texts_of(b)]).reshape(-1, 4)
            p = 1 / (1 + np.exp(-np.clip(x @ np.array(m.curve), -30, 30)))
            yield pa.StructArray.from_arrays([pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(np.rint(np.expm1(x[:, 3])).astype(np.int64))], results)

    # not deterministic for the planner only: else a filter on a result would run the function once more
    return df.withColumn("_m_found", scored.asNondeterministic()(F.col(text))).select(*keep, *[F.col(f"_m_found.{c}").alias(c) for c in results])
