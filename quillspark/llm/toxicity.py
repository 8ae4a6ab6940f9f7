"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear support vector machine.

Training (on the driver, from a bounded sample of labelled rows): strings that mark toxic documents are the landmarks;
a word's likeness to a landmark is the gap-weighted subsequence kernel (Lodhi et al., 2002), so inserted characters and
gaps lower it instead of hiding the word. A document has, for each landmark, the likeness of its most alike word and how
many different words are alike, softly and strictly, since some marks speak by their number only; the Nyström maps of
these are what the machine sees. Scoring is one Arrow pass over all whole texts: every word is compared with every
landmark, distinct words once.

Defined results: null and empty texts get the score of a text without any likeness; repeated rows get equal scores;
only id and text are read, other columns pass by; without toxic examples every score is 0; empty tables give no rows.
Very long texts are read whole. Runs of single letters are also read as one word.
"""

from __future__ import annotations

import math
import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import require

DECAY, LENGTH, WIDEST = 0.6, 4, 32
SHORTEST, LONGEST = 3, 12  # letters of a landmark
ALIKE = (0.5, 0.8)  # likenesses from which a word counts
SPACED = re.compile(r"(?<!\S)(?:\S[ \t]+){3,}\S(?!\S)")


def kernel(words: list[str], landmark: str) -> np.ndarray:
    """Gap-weighted kernel of each word with the landmark over the landmark's own; 1 at most."""
    p = min(LENGTH, len(landmark))
    own = raw_kernel(letters([landmark]), landmark, p)[0]
    return np.minimum(1, raw_kernel(letters(words), landmark, p) / own)


def letters(words: list[str]) -> np.ndarray:
    """Code points of each word, 0 behind its end."""
    width = max((len(w) for w in words), default=1)
    out = np.zeros((len(words), max(1, width)), np.uint32)
    for k, w in enumerate(words):
        out[k, : len(w)] = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def raw_kernel(codes: np.ndarray, landmark: str, p: int) -> np.ndarray:
    m, square = len(landmark), DECAY * DECAY
    hits = [codes == ord(c) for c in landmark]
    prime = np.zeros((p, m + 1, len(codes)))
    prime[0] = 1
    total = np.zeros(len(codes))
    for n in range(codes.shape[1]):
        for j in range(m):
            total += np.where(hits[j][:, n], square * prime[p - 1, j], 0)
        for i in range(p - 1, 0, -1):
            run = np.zeros(len(codes))
            for j in range(m):
                run = DECAY * run + np.where(hits[j][:, n], square * prime[i - 1, j], 0)
                prime[i, j + 1] = DECAY * prime[i, j + 1] + run
    return total


@dataclass
class Model:
    landmarks: list[str]
    weights: np.ndarray  # of the features: the machine's weights through the Nyström map
    bias: float
    slope: float
    shift: float

    def margin(self, features: np.ndarray) -> np.ndarray:
        return features @ self.weights + self.bias

    def of(self, features: np.ndarray) -> np.ndarray:
        return self.score(self.margin(features))

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500)))


class Likeness:
    """Likenesses of words to all landmarks; distinct words are compared once and remembered, up to a bound."""

    def __init__(self, landmarks: list[str], bound: int = 600_000):
        self.landmarks, self.bound = landmarks, bound
        self.alphabet = np.array(sorted({ord(c) for t in landmarks for c in t}), np.uint32)
        self.needs = [
            (np.searchsorted(self.alphabet, [ord(c) for c in own]), np.array([t.count(c) for c in own], np.int16), min(LENGTH, len(t)))
            for t, own in ((t, sorted(set(t))) for t in landmarks)
        ]
        self.known: dict[str, np.ndarray | None] = {}

    def counts(self, codes: np.ndarray) -> np.ndarray:
        """How often each word holds each letter of the landmarks."""
        at = np.minimum(np.searchsorted(self.alphabet, codes), max(0, len(self.alphabet) - 1))
        row, column = np.nonzero(self.alphabet[at] == codes) if len(self.alphabet) else (np.zeros(0, int), np.zeros(0, int))
        out = np.zeros((len(codes), len(self.alphabet)), np.int16)
        np.add.at(out, (row, at[row, column]), 1)
        return out

    def learn(self, words: set[str]) -> None:
        if len(self.known) > self.bound:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        by_width: dict[int, list[str]] = {}
        for w in new:
            self.known[w] = None
            if len(w) >= 3:
                by_width.setdefault(min(len(w), WIDEST) // 4, []).append(w)
        for group in by_width.values():
            # a long word is read in overlapping parts: no likeness spans more than half of one
            parts = [(w, w[a : a + WIDEST]) for w in group for a in range(0, max(1, len(w) - WIDEST // 2), WIDEST // 2)]
            codes = letters([x for _, x in parts])
            counts = self.counts(codes)
            found: dict[str, np.ndarray] = {}
            for j, t in enumerate(self.landmarks):
                # a common subsequence of p letters needs p letters in common, repeats counted
                own, times, p = self.needs[j]
                at = np.flatnonzero(np.minimum(counts[:, own], times).sum(axis=1) >= p)
                if len(at):
                    k = np.minimum(1, raw_kernel(codes[at], t, p) / raw_kernel(letters([t]), t, p)[0])
                    for a, x in zip(at[k > 0.05], k[k > 0.05], strict=True):
                        row = found.setdefault(parts[a][0], np.zeros(len(self.landmarks)))
                        row[j] = max(row[j], x)
            self.known |= found

    def documents(self, texts: list[str | None]) -> np.ndarray:
        """The features of each text: for each landmark the greatest likeness, and the logarithm of how many different
        words are alike by each of ALIKE."""
        split = []
        for t in texts:
            low = (t or "").lower()
            split.append({*low.split(), *(re.sub(r"\s", "", m[0]) for m in SPACED.finditer(low))})
        self.learn(set().union(*split))
        out = np.zeros((len(texts), 1 + len(ALIKE), len(self.landmarks)))
        for k, words in enumerate(split):
            rows = [self.known[w] for w in words if self.known[w] is not None]
            if rows:
                own = np.stack(rows)
                out[k, 0] = own.max(axis=0)
                for n, least in enumerate(ALIKE):
                    out[k, 1 + n] = np.log1p((np.maximum(0, own - least) / (1 - least)).sum(axis=0))
        return out.reshape(len(texts), (1 + len(ALIKE)) * len(self.landmarks))


def copy_groups(texts: list[str | None], pairs: int = 4) -> list[int]:
    """A number for each text that near copies share: texts with one of some pairs of MinHash values of word triples in common."""
    root = list(range(len(texts)))

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    first: dict[tuple[int, ...], int] = {}
    for n, text in enumerate(texts):
        words = (text or "").lower().split()
        triples = np.array([zlib.crc32(" ".join(words[k : k + 3]).encode("utf-8", "surrogatepass")) for k in range(max(1, len(words) - 2))], np.uint64)
        least = [int(((triples * np.uint64(2 * v + 0x9E3779B1) + np.uint64(v)) & np.uint64(0xFFFFFFFF)).min()) for v in range(2 * pairs)]
        for v in range(0, 2 * pairs, 2):
            other = top(first.setdefault((v, *least[v : v + 2]), n))
            root[max(other, top(n))] = min(other, top(n))
    return [top(n) for n in range(len(texts))]


def marks_of(text: str | None) -> set[str]:
    """Words and beginnings of words."""
    words = {w.strip(".,;:!?\"'()") for w in (text or "").lower().split()}
    return {w[:n] for w in words for n in range(SHORTEST, min(len(w), LONGEST) + 1)}


def choose_landmarks(texts: list[str | None], toxic: np.ndarray, chance: float = 0.5) -> list[str]:
    """Words and beginnings of words that toxic texts hold more often than chance has it.

    A string's likelihood ratio has to be one that fewer than `chance` strings would reach by accident; near copies count
    once. Of alike strings in much the same texts the one with the greatest ratio stands for all.
    """
    bad, good = Counter(), Counter()
    for t, y in zip(texts, toxic, strict=True):
        if y:
            bad.update(marks_of(t))
    need = 2 * math.log(max(2, len(bad)) / chance)
    bad = Counter({x: n for x, n in bad.items() if n >= 3})
    for t, y in zip(texts, toxic, strict=True):
        if not y:
            good.update(marks_of(t) & bad.keys())
    rate = min(0.99, max(1e-3, float(toxic.mean()) if len(toxic) else 0.5))

    def ratio(n: int, other: int) -> float:
        total = n + other
        if n < 3 or n <= max(0.25, 1.5 * rate) * total and other:
            return 0.0
        return 2 * (n * math.log(n / (total * rate)) + (other * math.log(other / (total * (1 - rate))) if other else 0.0))

    holders: dict[str, set[int]] = {x: set() for x, n in bad.items() if ratio(n, good[x]) >= need}
    for group, t, y in zip(copy_groups(texts), texts, toxic, strict=True):
        if y:
            for x in marks_of(t) & holders.keys():
                holders[x].add(group)
    strength = {x: ratio(len(own), good[x]) for x, own in holders.items()}

    def told(x: str, c: str) -> bool:
        return len(holders[x] & holders[c]) > 0.7 * len(holders[x]) and (x in c or c in x or x[:SHORTEST] == c[:SHORTEST] and kernel([x], c)[0] > 0.4)

    chosen: list[str] = []
    for x in sorted((x for x in holders if strength[x] >= need), key=lambda x: (-strength[x], -len(x), x)):
        if not any(told(x, c) for c in chosen):
            chosen.append(x)
    return chosen


def fit(texts: list[str | None], toxic: np.ndarray, cost: float = 1000.0) -> Model:
    landmarks = choose_landmarks(texts, toxic)
    if not landmarks:
        return Model([], np.zeros(0), -1.0, 0.0, -50.0)
    gram = np.stack([kernel(landmarks, t) for t in landmarks])
    values, vectors = np.linalg.eigh((gram + gram.T) / 2 + 1e-3 * np.eye(len(landmarks)))
    nystrom = np.kron(np.eye(1 + len(ALIKE)), vectors / np.sqrt(np.maximum(values, 1e-3)) @ vectors.T)
    likeness = Likeness(landmarks)
    features = np.concatenate([likeness.documents(texts[at : at + 500]) for at in range(0, len(texts), 500)])
    sign = np.where(toxic, 1.0, -1.0)
    weight = np.where(toxic, len(toxic) / max(1, 2 * toxic.sum()), len(toxic) / max(1, 2 * (~toxic).sum()))
    w, bias = squared_hinge(features @ nystrom, sign, weight * cost)
    weights = nystrom @ w
    slope, shift = platt(features @ weights + bias, toxic)
    return Model(landmarks, weights, bias, slope, shift)


def squared_hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, float]:
    """Newton's method on |w|^2 / 2 + sum of cost * max(0, 1 - y * (w x + b))^2 / n."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.eye(x1.shape[1])
    ridge[-1, -1] = 1e-6
    w, c = np.zeros(x1.shape[1]), cost / len(x) * 100
    for _ in range(50):
        at = y * (x1 @ w) < 1
        h = ridge + (x1[at].T * c[at]) @ x1[at]
        new = np.linalg.solve(h, (x1[at].T * c[at]) @ y[at])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w[:-1], float(w[-1])


def platt(margin: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through the margins, with Platt's smoothed targets."""
    n1, n0 = toxic.sum(), (~toxic).sum()
    target = np.where(toxic, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x1, w = np.stack([margin, np.ones(len(margin))], axis=1), np.array([2.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        h = (x1.T * (p * (1 - p) + 1e-9)) @ x1 + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x1.T @ (p - target))
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = 4000, sample_bytes: int = 1 << 27) -> Model:
    """Fits on a bounded sample of labelled documents, never on held-out ids: in the order of a hash of the id, the first
    sample_rows, or those up to the one whose text brings the sum to sample_bytes. Long texts are learnt from like others.
    """
    usable = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("y")).where("id IS NOT NULL AND y IS NOT NULL").where(~held_out(F.col("id"))).dropDuplicates(["id"])
    n = usable.count()
    place = F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(1 << 20))
    draw = usable.where(place < F.lit(int((1 << 20) * min(1.0, sample_rows / max(1, n))))).limit(2 * sample_rows)
    texts = require(docs, [id_col, text_col]).toDF("id", "text")
    sizes = texts.join(F.broadcast(draw), "id").select(place.alias("place"), "id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).toPandas().sort_values(["place", "id"])
    taken = sizes[sizes["size"].cumsum() - sizes["size"] < sample_bytes].id.drop_duplicates().tolist()
    chosen = docs.sparkSession.createDataFrame([(int(i),) for i in taken], "id long").join(draw, "id")
    rows = texts.join(F.broadcast(chosen), "id").select("text", "y").toPandas()
    rows = rows.assign(key=[hash_text(t) for t in rows.text]).sort_values("key").drop_duplicates(["key", "y"])
    return fit(rows.text.tolist(), rows.y.to_numpy() == 1)


def hash_text(text: str | None) -> bytes:
    import hashlib

    return hashlib.blake2b((text or "").encode("utf-8", "surrogatepass"), digest_size=12).digest()


def held_out(doc_id) -> "F.Column":
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def scorer(model: Model):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        likeness = Likeness(model.landmarks)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                scores = model.of(likeness.documents(part.column(part.num_columns - 1).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores)], names=["doc_id", "score"])

    return emit


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score and predicted of each row."""
    scored = require(docs, [id_col, text_col]).mapInArrow(scorer(model), "doc_id long, score double")
    return scored.select(
        F.col("doc_id").alias(id_col), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def text_scorer(model: Model):
    """The score of a text column, for filters that keep all columns."""
    @F.pandas_udf(T.DoubleType())
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        likeness = Likeness(model.landmarks)
        for texts in parts:
            parts = [model.of(likeness.documents(texts.iloc[at : at + 1000].tolist())) for at in range(0, len(texts), 1000)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return score


cloudpickle.register_pickle_by_value(sys.modules[__name__])
