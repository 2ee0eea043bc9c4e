"""Katz backoff language model.

Tables, stored and partitioned by order: grams(key, hist, low, c, p) and histories(hist, alpha). Counts of at most CUT are
discounted by Good-Turing; what a history's seen grams leave is dealt to the unseen ones in proportion to the lower order, and alpha is
that rest over one minus the lower-order sum of the seen grams, so each history's distribution sums to one exactly. A seen
gram's suffix is a seen gram too, so the lower-order probability is one equi-join away. Order one keeps a share for a
single unknown word. A history without a rest (all counts above CUT) has one count added to its total to leave one.

A text is scored token by token: a seen gram has its own probability, an unseen one its history's alpha (1 for a history
not seen) times the lower order's, down to order one. This is evaluated once for each distinct gram of the corpus and then
summed over the texts. The query uses katz_packed.py, the same model of order two with less shuffling. Words are compared as 64-bit hashes. Null and empty texts are one end token. Rows that repeat a
doc_id are scored together with the id's other rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import lower_ascii, stored

ORDER, CUT = 2, 5
_START, _END = "\x01", "\x02 "  # the end holds a space, the start is never predicted: no word equals either as a token


def events(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """row, train and, for each token, the keys g1..gm of its grams and h2..hm of their histories."""
    words = F.filter(F.split(lower_ascii(F.coalesce("text", F.lit(""))), "[\\x20\\x09-\\x0D]+"), lambda x: x != "")
    d = docs.select("row", "train", F.transform(words, lambda x: F.xxhash64(x)).alias("w"))
    pad = F.array_repeat(F.xxhash64(F.lit(_START)), order - 1)
    d = d.select("row", "train", F.concat(pad, "w", F.array(F.xxhash64(F.lit(_END)))).alias("w"))
    fields = ["get(w, i) AS g1"]
    for m in range(2, order + 1):
        hist = ", ".join(f"get(w, i - {j})" for j in range(m - 1, 0, -1))
        fields += [f"xxhash64({m}, {hist}, get(w, i)) AS g{m}", f"xxhash64({m}, {hist}) AS h{m}"]
    tokens = F.explode(F.expr(f"transform(sequence({order - 1}, size(w) - 1), i -> struct({', '.join(fields)}))")).alias("t")
    return d.select("row", "train", tokens).select("row", "train", "t.*")


def discounts(grams: DataFrame, cut: int = CUT) -> dict[int, float]:
    """d_r for r up to cut, from the grams' counts of counts."""
    return discounts_of({r.c: r.n for r in grams.where(F.col("c").between(1, cut + 1)).groupBy("c").agg(F.count("*").alias("n")).collect()}, cut)


def discounts_of(n: dict[int, int], cut: int = CUT) -> dict[int, float]:
    """d_r for r up to cut; where Katz's formula leaves (0, 1], n1 / (n1 + 2 n2) is taken off instead."""
    n1 = n.get(1, 0)
    out = {}
    for r in range(1, cut + 1):
        d = None
        if n1 and n.get(r) and n.get(r + 1) and (rest := (cut + 1) * n.get(cut + 1, 0) / n1) < 1:
            d = ((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest)
        if d is None or not 0 < d <= 1:
            d = 1 - (n1 / (n1 + 2 * n.get(2, 0)) if n1 else 0.0) / r
        out[r] = max(d, 1e-3)
    return out


def _discounted(d: dict[int, float]) -> Column:
    """c times its discount."""
    value = F.col("c").cast("double")
    for r, x in d.items():
        value = F.when(F.col("c") == r, F.lit(r * x)).otherwise(value)
    return value


class Model:
    """All grams of a corpus by order, train counts c (0: only in other rows) and probabilities p."""

    def __init__(self, tokens: DataFrame, order: int = ORDER, cut: int = CUT) -> None:
        self.order = order
        train = F.sum(F.col("train").cast("long"))
        one = stored(tokens.groupBy(F.col("g1").alias("key")).agg(train.alias("c")), "grams-1")
        total = one.agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v")).first()
        self.train_tokens, self.types = total.n or 0, total.v or 0
        d = discounts(one, cut)
        mass = one.where("c > 0").agg(F.sum(_discounted(d))).first()[0] or 0.0
        n = max(1, self.train_tokens)
        unknown = max(1.0 - mass / n, 0.5 / (n + 0.5 * (self.types + 1)))
        scale = (1.0 - unknown) / mass if mass else 0.0
        self.tables = [one.select("key", "c", F.when(F.col("c") > 0, _discounted(d) * scale).otherwise(unknown).alias("p"))]
        for m in range(2, order + 1):
            self.tables.append(self._order(tokens, m, cut))

    def _order(self, tokens: DataFrame, m: int, cut: int) -> DataFrame:
        keys = tokens.groupBy(F.col(f"g{m}").alias("key")).agg(F.first(f"h{m}").alias("hist"), F.first(f"g{m - 1}").alias("low"), F.sum(F.col("train").cast("long")).alias("c"))
        lower = self.tables[-1].select(F.col("key").alias("low"), F.col("p").alias("lower"))
        grams = stored(keys.join(lower, "low").withColumn("order", F.lit(m)), f"grams-{m}", ["order"])
        d = discounts(grams, cut)
        sums = grams.where("c > 0").groupBy("hist").agg(F.sum("c").alias("all"), F.sum(_discounted(d)).alias("kept"), F.sum("lower").alias("taken"))
        total = F.when(F.col("all") - F.col("kept") > 1e-9 * F.col("all"), F.col("all")).otherwise(F.col("all") + 1)
        alpha = (1 - F.col("kept") / total) / F.greatest(1 - F.col("taken"), F.lit(1e-12))
        histories = stored(sums.select("hist", total.cast("double").alias("total"), alpha.alias("alpha"), F.lit(m).alias("order")), f"histories-{m}", ["order"])
        p = F.when(F.col("c") > 0, _discounted(d) / F.col("total")).otherwise(F.coalesce("alpha", F.lit(1.0)) * F.col("lower"))
        return stored(grams.join(histories.drop("order"), "hist", "left").select("key", "c", p.alias("p"), F.lit(m).alias("order")), f"model-{m}", ["order"]).drop("order")


def score(docs: DataFrame, held_out, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. held_out: which ids the model doesn't learn from."""
    rows = docs.select(F.col("doc_id").alias("row"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held"), "text")
    rows = rows.withColumn("train", ~F.col("held"))
    tokens = events(rows, order)
    model = Model(tokens, order)
    n, v = model.train_tokens, model.types
    low = model.tables[0].select(F.col("key").alias("g1"), F.col("c").alias("c1"))
    top = model.tables[-1].select(F.col("key").alias(f"g{order}"), F.log10("p").alias("logp"))
    base = F.log10((F.col("c1") + 0.5) / (n + 0.5 * (v + 1)))
    joined = tokens.select("row", "train", "g1", *({f"g{order}"} - {"g1"}))
    by_low = joined.groupBy("row", "train", "g1").agg(F.count("*").alias("n")).join(low, "g1").groupBy("row", "train").agg(
        F.sum("n").alias("n_tokens"), F.sum(F.when(F.col("c1") > 0, F.col("n")).otherwise(0)).alias("n_known"), F.sum(base * F.col("n")).alias("base_score")
    )
    by_top = joined.groupBy("row", f"g{order}").agg(F.count("*").alias("n")).join(top, f"g{order}").groupBy("row").agg(F.sum(F.col("logp") * F.col("n")).alias("score"))
    out = by_low.join(by_top.withColumnRenamed("row", "row_"), F.col("row").eqNullSafe(F.col("row_")))
    return out.select(F.col("row").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")

