"""Quality classifier by co-training.

Two views of a document: measures of its text, and its metadata (lang, source, n_chars). A classifier for each view is fitted
on labelled rows; over some rounds each judges all unlabelled rows, and those it is sure of join the other's training rows with its
judgement as their label. Both are then calibrated on a held-out fold and combined there by a logistic model of their logits.

Everything that touches the corpus is a built-in expression: the measures, which are stored once, and the fitted models as sums of steps.
Bounded samples of measures (no texts) come to the driver: of the labelled rows, and of the rows that a view is sure of in a round.
Null texts count as empty, null metadata is a value of its own, labels other than 0 and 1 aren't used; without usable labels of both
classes every score is 1 and every row is kept. Rows are judged one by one, whole texts of any length and rows that repeat an id or have
none too; where labels repeat an id, the lower label wins. An empty table gives no rows. Of the documents doc_id, text, lang, source
and n_chars are read, of the labels doc_id and quality: other columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import fold, stored
from graphloom.llm.linear import logistic, platt, sigmoid, step_edges

#: Bounds of the fit, in expectation: labelled rows, and rows with a label by a view, of all that the view is sure of in a round.
SAMPLE, PSEUDO = 20_000, 2_000
#: Co-training rounds, the share of the unlabelled rows that each view labels in a round, and how sure it must be.
ROUNDS, SHARE, SURE = 5, 0.05, 0.95
SOURCES, LANGS = 64, 16
#: Rows with a combined probability of good quality under this are rejected.
THRESHOLD = 0.5

TEXT = ("log_words", "word_chars", "symbols", "shouts", "upper", "digits", "pipes", "letters", "dup_lines", "distinct_words", "words_a_line")
META = ("log_chars", "source", "lang")


def measured(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and the measures of both views; columns named in keep are carried along as kept_<name>."""
    t = F.coalesce(F.col("text"), F.lit(""))
    own = [F.col(c).alias(f"kept_{c}") for c in keep]
    d = docs.select("doc_id", t.alias("t"), "lang", "source", F.col("n_chars").cast("double").alias("n_chars"), *own)
    d = d.withColumn("w", F.filter(F.split("t", "[\\x20\\x09-\\x0D]+"), lambda x: x != ""))
    d = d.withColumn("lines", F.split("t", "\n"))
    d = d.withColumn("n_w", F.greatest(F.size("w"), F.lit(1)).cast("double"))
    bare = F.translate("t", " \t\n\x0b\x0c\r", "")
    d = d.withColumn("n_c", F.greatest(F.length(bare), F.lit(1)).cast("double"))
    left = lambda pattern: F.length(F.regexp_replace("t", pattern, ""))
    without = lambda chars: F.length("t") - F.length(F.translate("t", chars, ""))
    return d.select(
        "doc_id",
        *[f"kept_{c}" for c in keep],
        F.log1p(F.size("w").cast("double")).alias("log_words"),
        (F.col("n_c") / F.col("n_w")).alias("word_chars"),
        (without("#*$%&<>@^~{}[]\\_=+") / F.col("n_c")).alias("symbols"),
        (without("!?") / F.col("n_w")).alias("shouts"),
        (left("[^\\p{Lu}]+") / F.col("n_c")).alias("upper"),
        (without("0123456789") / F.col("n_c")).alias("digits"),
        (without("|") / F.col("n_w")).alias("pipes"),
        (left("[^\\p{L}]+") / F.col("n_c")).alias("letters"),
        (1 - F.size(F.array_distinct("lines")) / F.size("lines")).alias("dup_lines"),
        (F.size(F.array_distinct("w")) / F.col("n_w")).alias("distinct_words"),
        (F.col("n_w") / F.size("lines")).alias("words_a_line"),
        F.coalesce(F.log1p(F.greatest("n_chars", F.lit(0.0))), F.lit(-1.0)).alias("log_chars"),
        F.pmod(F.xxhash64(F.coalesce(F.col("source").cast("string"), F.lit("\0"))), F.lit(SOURCES)).cast("int").alias("source"),
        F.pmod(F.xxhash64(F.coalesce(F.col("lang").cast("string"), F.lit("\0"))), F.lit(LANGS)).cast("int").alias("lang"),
    )


@dataclass
class View:
    """A logistic model over indicators: of reaching an edge of a measure, or of being a bucket of a category."""

    edges: dict[str, list[float]]
    categories: dict[str, int]
    weights: np.ndarray = None
    bias: float = 0.0
    slope: float = 1.0
    offset: float = 0.0

    @classmethod
    def over(cls, rows, steps, categories) -> View:
        return cls({c: step_edges(rows[c].to_numpy(float)) for c in steps}, categories)

    def matrix(self, rows) -> np.ndarray:
        cols = [rows[c].to_numpy(float)[:, None] >= np.array(e)[None, :] for c, e in self.edges.items()]
        cols += [rows[c].to_numpy(int)[:, None] == np.arange(n)[None, :] for c, n in self.categories.items()]
        return np.concatenate(cols, axis=1).astype(np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        self.weights, self.bias = logistic(x, y, l2=2.0)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.slope * (x @ self.weights + self.bias) + self.offset

    def column(self) -> Column:
        """The calibrated logit as an expression."""
        z, k = F.lit(float(self.bias)), 0
        for c, edges in self.edges.items():
            reached = np.cumsum(self.weights[k : k + len(edges)])
            step = F
            for e, w in zip(edges[::-1], reached[::-1], strict=True):  # edges ascend: the highest one reached counts for those below
                step = step.when(F.col(c) >= F.lit(e), F.lit(float(w)))
            z = z + step.otherwise(F.lit(0.0)) if edges else z
            k += len(edges)
        for c, n in self.categories.items():
            z = z + F.element_at(F.array(*[F.lit(float(w)) for w in self.weights[k : k + n]]), F.col(c) + 1)
            k += n
        return z * float(self.slope) + float(self.offset)


@dataclass
class Model:
    text: View
    meta: View
    mix: tuple[float, float, float]

    def probability(self) -> Column:
        """The combined probability over the columns of measured()."""
        a, b, c = self.mix
        return 1 / (1 + F.exp(-(self.text.column() * a + self.meta.column() * b + c)))

    def scored(self, rows: DataFrame) -> DataFrame:
        a, b, c = self.mix
        both = rows.select("doc_id", self.text.column().alias("zt"), self.meta.column().alias("zm"))
        prob = lambda z: 1 / (1 + F.exp(-z))
        return both.select("doc_id", prob(F.col("zt")).alias("text_score"), prob(F.col("zm")).alias("metadata_score"), prob(F.col("zt") * a + F.col("zm") * b + c).alias("score"))


def usable(labels: DataFrame, trains) -> DataFrame:
    """(_id, y) of the labels that may be learnt from."""
    rows = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("y")).where("y IN (0, 1) AND _id IS NOT NULL").where(trains(F.col("_id")))
    return rows.groupBy("_id").agg(F.min("y").alias("y"))


def _part(c, salt: int) -> Column:
    return F.pmod(F.xxhash64(c, F.lit(salt)), F.lit(1 << 20))


def _share(most: float, n: int) -> int:
    return int((1 << 20) * min(1.0, most / max(1, n)))


def train(rows: DataFrame, labels: DataFrame, trains=lambda c: fold(c) != 0) -> Model | None:
    """rows: a stored table of measured()."""
    known = usable(labels, trains)
    n = known.count()
    picked = F.broadcast(known.where(_part(F.col("_id"), 1) < _share(SAMPLE, n)))
    known = rows.join(picked, rows["doc_id"] == F.col("_id")).select("*", (fold(F.col("doc_id")) == 1).alias("cal")).toArrow().to_pandas()
    fit, cal = known[~known["cal"]], known[known["cal"]]
    if len(set(fit["y"])) < 2:
        return None
    free = rows.join(picked, rows["doc_id"] == F.col("_id"), "left_anti").where(trains(F.col("doc_id")))
    total = free.count()
    views = [View.over(fit, TEXT, {}), View.over(fit, META[:1], {"source": SOURCES, "lang": LANGS})]
    y = fit["y"].to_numpy(float)
    own = [v.matrix(fit) for v in views]
    extra: list[dict] = [{}, {}]  # (id, measures) -> (its indicators, label by the other view), for each view's training
    base = y.mean()
    for turn in range(ROUNDS + 1):
        for v, x, e in zip(views, own, extra, strict=True):
            found = list(e.values())
            v.fit(np.concatenate([x, *[f[None] for f, _ in found]]), np.concatenate([y, [p for _, p in found]]))
        if turn == ROUNDS or not total:
            continue
        want = min(PSEUDO, SHARE * total)
        # columns of their own, so that a plan holds each model once and not for each use
        judged = free.select("*", *[(1 / (1 + F.exp(-v.column()))).alias(f"p{k}") for k, v in enumerate(views)])
        sure = [(k, label, F.col(f"p{k}") < 1 - SURE if label == 0 else F.col(f"p{k}") > SURE) for k in range(len(views)) for label in (0, 1)]
        counts = judged.agg(*[F.count_if(c) for _, _, c in sure]).first()
        least = F.lit(False)
        marks = []
        for (k, label, c), m in zip(sure, counts, strict=True):
            marks.append(c & (_part(F.col("doc_id"), 10 + turn) < _share(want * (base if label else 1 - base), m)))
            least = least | marks[-1]
        new = judged.where(least).select("*", *[m.alias(f"m{i}") for i, m in enumerate(marks)]).toArrow().to_pandas()
        for i, (k, label, _) in enumerate(sure):
            rows_ = new[new[f"m{i}"]]
            keys = zip(rows_["doc_id"].tolist(), rows_["log_words"].tolist(), rows_["log_chars"].tolist(), strict=True)
            extra[1 - k].update(zip(keys, ((f, float(label)) for f in views[1 - k].matrix(rows_)), strict=True))
    held = cal if len(set(cal["y"])) == 2 else fit
    truth = held["y"].to_numpy(float)
    z = []
    for v in views:
        raw = v.logit(v.matrix(held))
        v.slope, v.offset = platt(raw, truth)
        z.append(v.slope * raw + v.offset)
    w, c = logistic(np.column_stack(z), truth, l2=0.1)
    return Model(views[0], views[1], (max(0.0, float(w[0])), max(0.0, float(w[1])), c))


def judge(rows: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_score, metadata_score, score, kept for each row of measured()."""
    if model is None:
        one = F.lit(1.0)
        return rows.select("doc_id", one.alias("text_score"), one.alias("metadata_score"), one.alias("score"), F.lit(True).alias("kept"))
    return model.scored(rows).withColumn("kept", F.col("score") >= threshold)


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    rows = stored(measured(spark.read.parquet(f"{sf_dir}/documents.parquet")), "measured")
    model = train(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(rows, model).withColumn("held_out", fold(F.col("doc_id")) == 0)
