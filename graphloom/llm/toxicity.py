"""Toxicity by weak supervision.

1. On a bounded sample of labelled rows of the training folds, word and word-stem features are counted by label and those
   that mark toxic texts become lexicons: the words and the 4- and 5-letter stems (patterns for words of unseen endings).
2. Many voters, each a part of one lexicon or a pattern of writing, vote toxic, clean or nothing on the sample's texts.
3. A generative label model estimates by expectation maximisation how each voter votes on either class. Voters that go
   together more than the classes explain share their weight. It sees votes only and gives each text a posterior label.
4. A linear classifier over the lexicon features is trained on the posterior labels and scores every whole text.

Neither labels nor lang, source or doc_id are inputs of a score. Null and empty texts get the score of a text without any feature. A
null doc_id counts as an empty id in the folds. Labels other than 0 and 1, or null, aren't used; without usable labels every score is 0.
Rows are scored one by one, whole texts of any length and rows that repeat an id too; where labels repeat an id, toxic wins. An empty
table gives no rows. Of the documents only doc_id and text are read, of the labels doc_id and toxic: other columns may have any name.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import fold, slices, stored, words_of
from graphloom.llm.linear import logistic, sigmoid

#: Bound of the fit: labelled rows (in expectation). What is learnt from them has no bound of its own.
SAMPLE = 20_000
#: A candidate is in so many toxic texts, and this share of the texts that have it is toxic. An entry is added while it marks
#: so many toxic texts that have fewer than COVER entries so far.
LEAST, PRECISION, COVER = 4, 0.9, 4
#: Voters that each lexicon is dealt to.
PARTS = 10
_letters = regex.compile(r"\p{L}+").findall


def features_of(word: str) -> list[str]:
    """Features of one white-space word: its letter runs and their stems."""
    out = []
    for w in _letters(word.lower()):
        out.append("w" + w)
        if len(w) >= 4:
            out.append("4" + w[:4])
        if len(w) >= 5:
            out.append("5" + w[:5])
    return out


def labelled(docs: DataFrame, labels: DataFrame, label: str, trains, most: int = SAMPLE) -> DataFrame:
    """(doc_id, text, y) of training rows with a usable label: all, or about `most` by a hash of the id.

    The sampled ids, bounded by `most`, are broadcast, so that the texts aren't shuffled."""
    usable = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("y")).where("y IN (0, 1) AND _id IS NOT NULL").where(trains(F.col("_id")))
    usable = usable.groupBy("_id").agg(F.max("y").alias("y"))
    n = usable.count()
    if n > most:
        usable = usable.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < int((1 << 20) * most / n))
    rows = docs.select("doc_id", "text")
    return rows.join(F.broadcast(usable), rows["doc_id"] == usable["_id"]).select("doc_id", "text", "y")


def _count(batches):
    for batch in batches:
        seen, toxic = Counter(), Counter()
        for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
            own = {f for w in set((text or "").split()) for f in features_of(w)}
            seen.update(own)
            if y:
                toxic.update(own)
        keep = [(f, n, toxic[f]) for f, n in seen.items() if toxic[f]]
        rest = [(f, n, 0) for f, n in seen.items() if not toxic[f]]
        rows = keep + rest
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["f", "n", "t"])


def lexicon(sample: DataFrame) -> list[str]:
    """Entries that between them mark each toxic text several times, chosen greedily, so that rare words which only
    happen to stand in toxic texts beside a marking stem aren't entries. A chosen stem stands for its longer forms."""
    counted = sample.mapInArrow(_count, "f string, n long, t long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    marked = counted.where((F.col("t") >= LEAST) & (F.col("t") >= PRECISION * F.col("n") + 0.4))
    names = [r.f for r in marked.orderBy(F.desc("t"), F.length("f"), "f").collect()]  # of the bounded sample
    rows = sample.where("y = 1").select("text").mapInArrow(_evidence({f: i for i, f in enumerate(names)}), _EVIDENCE).select("features").collect()
    has: list[list[int]] = [[] for _ in names]
    for i, r in enumerate(rows):
        for f in r.features:
            has[f].append(i)
    cover, gain, out = [0] * len(rows), [len(x) for x in has], []
    while names:
        f = max(range(len(names)), key=gain.__getitem__)
        gain[f] = sum(cover[i] < COVER for i in has[f])
        if gain[f] < max(gain):
            continue
        if gain[f] < LEAST:
            break
        for i in has[f]:
            cover[i] += 1
        out.append(names[f])
        for g, name in enumerate(names):
            if name[1:].startswith(names[f][1:]):  # the stem's own longer forms would only vote as it does
                gain[g] = 0
                has[g] = []
    return out


def hits(texts: pa.Array, index: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs of the texts."""
    offsets, words = words_of(texts)
    if not len(words):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    coded = words.dictionary_encode()
    own = [[index[f] for f in features_of(w) if f in index] for w in coded.dictionary.to_pylist()]
    marked = np.array([bool(x) for x in own])
    codes = coded.indices.to_numpy()
    at = np.flatnonzero(marked[codes])
    rows = np.searchsorted(offsets, at, side="right") - 1
    pairs = {(int(r), f) for r, c in zip(rows, codes[at], strict=True) for f in own[c]}
    return np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)


#: Patterns of writing that vote toxic when found; the label model learns what they are worth.
PATTERNS = (r"\b(you|tu|du|sie|vous|usted)\b[^.!?]{0,20}!", r"\p{Lu}{4,}[^\n]{0,20}!", r"([!?])\1{2,}", r"[@#$%&*]{3,}")
_patterns = [regex.compile(p, regex.I if i == 0 else 0) for i, p in enumerate(PATTERNS)]


_EVIDENCE = "features array<int>, patterns array<boolean>"


def _evidence(index: dict[str, int]):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                rows, found = hits(part.column("text"), index)
                own = [[] for _ in range(part.num_rows)]
                for r, f in zip(rows, found, strict=True):
                    own[r].append(int(f))
                texts = part.column("text").to_pylist()
                seen = [[bool(p.search(t or "")) for p in _patterns] for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.int32())), pa.array(seen, pa.list_(pa.bool_()))], names=["features", "patterns"])

    return run


@dataclass
class LabelModel:
    """P(vote | class) of each voter (votes 0: none, 1: toxic, 2: clean), the share of toxic texts, and voter weights."""

    table: np.ndarray = field(default_factory=lambda: np.empty((0, 2, 3)))
    prior: float = 0.5
    weight: np.ndarray = field(default_factory=lambda: np.empty(0))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        z = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for j in range(votes.shape[1]):
            ratio = np.log(self.table[j, 1] / self.table[j, 0])
            ratio[0] = 0.0  # a voter that says nothing is no evidence: most lexicons have no word of a text's language
            z += self.weight[j] * ratio[votes[:, j]]
        return sigmoid(z)

    @classmethod
    def fit(cls, votes: np.ndarray, prior: float, rounds: int = 30) -> LabelModel:
        """prior: the share of toxic texts, which the votes alone don't tell."""
        n, m = votes.shape
        model = cls(np.zeros((m, 2, 3)), float(np.clip(prior, 0.005, 0.995)), np.ones(m))
        toxic, clean = (votes == 1).sum(1), (votes == 2).sum(1)
        p = np.where(toxic > 0, np.minimum(0.98, 0.6 + 0.1 * toxic), np.where(clean > 0, 0.02, 0.2))
        for turn in range(rounds):
            for c, q in enumerate((1 - p, p)):
                for v in range(3):
                    model.table[:, c, v] = (q @ (votes == v) + 0.5) / (q.sum() + 1.5)
            if turn % 10 == 9:
                model.weight = cls._shared(votes, p)
            p = model.posterior(votes)
        return model

    @staticmethod
    def _shared(votes: np.ndarray, p: np.ndarray) -> np.ndarray:
        """1 over one plus a voter's correlations with others in voting toxic that remain within the classes."""
        signed = (votes == 1).astype(float)
        rest = signed.copy()
        for q in (p, 1 - p):
            mean = (q @ signed) / max(q.sum(), 1e-9)
            rest -= q[:, None] * mean
        cov = rest.T @ rest / max(1, len(votes))
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        r = np.clip(cov / np.outer(sd, sd), 0, 1)
        r[r < 0.3] = 0
        np.fill_diagonal(r, 0)
        return 1.0 / (1.0 + r.sum(1))


def votes_of(features: list, patterns: list, names: list[str]) -> np.ndarray:
    """Each lexicon kind is dealt into PARTS voters; one voter votes clean without any entry; then the patterns."""
    kinds = {k: i for i, k in enumerate("w45")}
    part_of = np.array([kinds[f[0]] * PARTS + i % PARTS for i, f in enumerate(names)], np.int64)
    none = len(kinds) * PARTS
    out = np.zeros((len(features), none + 1 + len(PATTERNS)), np.int8)
    for i, own in enumerate(features):
        out[i, part_of[own]] = 1
        out[i, none] = 0 if own else 2
        out[i, none + 1 :] = patterns[i]
    return out


@dataclass
class Model:
    names: list[str]
    weights: np.ndarray
    bias: float
    label_model: LabelModel

    def scores(self, texts: pa.Array) -> np.ndarray:
        z = np.full(len(texts), self.bias)
        rows, found = hits(texts, {f: i for i, f in enumerate(self.names)})
        np.add.at(z, rows, self.weights[found])
        return sigmoid(z)


def train(docs: DataFrame, labels: DataFrame, trains=lambda c: fold(c) != 0) -> Model:
    """docs (doc_id, text), labels (doc_id, toxic). trains: which ids may be learnt from."""
    sample = stored(labelled(docs, labels, "toxic", trains), "toxic-sample")
    names = lexicon(sample)
    index = {f: i for i, f in enumerate(names)}
    rows = sample.select("text").mapInArrow(_evidence(index), _EVIDENCE).collect()
    if not names:
        return Model([], np.zeros(0), -40.0, LabelModel())
    share = sample.agg(F.avg("y")).first()[0]
    own = [r.features for r in rows]
    votes = votes_of(own, [r.patterns for r in rows], names)
    model = LabelModel.fit(votes, share)
    p = model.posterior(votes)
    x = np.zeros((len(rows), len(names)), np.float32)
    for i, fs in enumerate(own):
        x[i, fs] = 1
    w, b = logistic(x, p, l2=0.02, steps=800)
    return Model(names, np.maximum(w, 0.0), b, model)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row; a map without shuffle."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.scores(part.column("text")), pa.float64())], names=["doc_id", "score"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns as they are, that score under the threshold."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array(model.scores(part.column("text")) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
