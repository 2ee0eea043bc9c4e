"""URL filter: rules first, then words of host and path under naive Bayes.

Rules name a host with its subdomains and the beginning of a path; the longest that fits decides. For the rest, labels of the
host are split into words by unigram Viterbi (counts of all words of all pages' texts, kept as a table) and multinomial naive
Bayes scores these words and those of the path. Its training rows are the urls whose host holds a seed word, to block, and the others that
a rule allows; what a rule alone blocks is blocked for its place, which says nothing of its words, and stays out. The endings that rules are made of (top-level label and first path part) are left out in training, not in scoring.
A url is blocked from a threshold on that, with the classes' prior odds, which a fifth of the urls chooses: odds fitted on the
others judge their training rows, and the middle of the thresholds with the best balanced accuracy is taken.

Tokens are hashed into a fixed number of buckets, so the odds are two fixed arrays. A run of letters is looked up by its substrings of KEY letters
at most, taken from slices of it: shorter words are such a substring, a longer one has its first KEY letters as key, whatever its length. Urls meet the words of their runs of letters in
a join, whose frequent keys are dealt by salts. A null url or one
without "://" has an empty host and path, no rule and no word, and is allowed. Null html gives no words. Rows are judged one by one, urls
of any length and rows that repeat a page_id or have none too; without any rule or seed among the urls every other url is allowed, and an
empty table gives no rows. Only page_id, url and html are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import stored

#: (verdict, host and path prefix).
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Words that mark hosts of unwanted kinds (fixed values).
SEEDS = ("casino", "bet", "bets", "poker", "pills", "viagra", "cheap", "free", "win", "adult", "xxx", "porn", "spam", "ads", "track", "loan", "farm")
#: Buckets of the classifier, and tasks that a frequent key of a join is dealt to.
BUCKETS, SALTS = 1 << 16, 16
#: Letters of a key that words are looked up by, and letters of a run that make a slice.
KEY, SLICE = 16, 2048
#: Pseudo-counts of each token, dealt to the classes as all tokens are.
SMOOTHING = 1.0
#: Urls held out to choose a threshold, one in so many, and the threshold where they don't hold both classes.
HELD, THRESHOLD = 5, math.log(6.0)
#: Steps of the scores that thresholds are chosen from, and their range.
STEP, RANGE = 0.125, 32.0


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) as the module says."""
    u = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.substr(u, F.instr(u, "://") + 3))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    none = F.lit("")
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), none), F.coalesce(path, none)


def parsed(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, ruling (both null where no rule fits)."""
    d = pages.select("page_id", "url")
    host, path = parts(F.col("url"))
    d = d.select("page_id", host.alias("host"), path.alias("path"))
    rule, ruling = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, text in sorted(rules, key=lambda r: len(r[1])):
        own, slash, prefix = text.partition("/")
        fits = (F.col("host") == own) | F.col("host").endswith("." + own)
        fits = fits & F.col("path").startswith(slash + prefix)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        ruling = F.when(fits, F.lit(verdict)).otherwise(ruling)
    return d.select("*", rule.alias("rule"), ruling.alias("ruling"))


def vocabulary(pages: DataFrame) -> DataFrame:
    """w, n: every lower-case word of all pages' html outside tags, with its count; seed words are raised by a floor."""
    text = F.lower(F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", " "))
    words = pages.select(F.explode(F.split(text, "[^a-z]+")).alias("w")).where("w <> ''")
    counts = stored(words.groupBy("w").agg(F.count("*").alias("n")), "words")
    least = max(10, (counts.agg(F.sum("n")).first()[0] or 0) // 10_000)
    seen = {r.w: r.n for r in counts.where(F.col("w").isin(*SEEDS)).collect()}
    seeds = pages.sparkSession.createDataFrame([(w, seen.get(w, 0) + least) for w in SEEDS], "w string, n long")
    return counts.where(~F.col("w").isin(*SEEDS)).unionByName(seeds)


@dataclass
class Segmenter:
    """Splits a run of letters into its most probable words; unknown stretches cost more the longer they are. counts may hold
    only the words that occur in the run, if total is that of all."""

    counts: dict[str, int]
    total: int | None = None

    def __post_init__(self) -> None:
        total = (sum(self.counts.values()) if self.total is None else self.total) + 1.0
        self.cost = {w: -math.log(n / total) for w, n in self.counts.items()}
        self.sizes = sorted({len(w) for w in self.counts}, reverse=True)
        self.unknown = math.log(total) + 2.0

    def split(self, letters: str) -> list[str]:
        n = len(letters)
        best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
        start, ahead = 0, 0.0  # where an unknown stretch begins best, and its cost there less 3 a letter before
        for j in range(1, n + 1):
            best[j], back[j] = ahead + self.unknown + 3.0 * j, start
            for size in self.sizes:
                if size <= j and (own := self.cost.get(letters[j - size : j])) is not None and best[j - size] + own < best[j]:
                    best[j], back[j] = best[j - size] + own, j - size
            if best[j] - 3.0 * j < ahead:
                start, ahead = j, best[j] - 3.0 * j
        out, j = [], n
        while j:
            out.append(letters[back[j] : j])
            j = back[j]
        return out[::-1]


def segmented(runs: DataFrame, words: DataFrame) -> DataFrame:
    """run, words: each distinct run of letters, split. Its substrings are looked up among all words, so that a task holds only
    the counts of words that occur in the run at hand, and of longer ones that begin like a part of it."""
    total = words.agg(F.sum("n")).first()[0]
    runs = stored(runs.select("run", F.monotonically_increasing_id().alias("id")), "runs")
    slices = runs.select("id", F.explode(F.expr(f"transform(sequence(1, length(run), {SLICE}), i -> substring(run, i, {SLICE + KEY - 1}))")).alias("s"))
    inner = f"transform(sequence(1, least({KEY}, length(s))), l -> transform(sequence(1, length(s) - l + 1), i -> substring(s, i, l)))"
    inside = slices.select("id", F.explode(F.expr(f"array_distinct(flatten({inner}))")).alias("key"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt")).distinct()
    keyed = words.withColumn("key", F.substring("w", 1, KEY))
    needed = salted(keyed.join(inside.select("key").distinct(), "key", "left_semi"))
    found = inside.join(needed, ["key", "salt"]).groupBy("id").agg(F.collect_list(F.struct("w", "n")).alias("found"))

    def split(batches):
        for batch in batches:
            runs, found = batch.column("run").to_pylist(), batch.column("found").to_pylist()
            out = [Segmenter({x["w"]: x["n"] for x in f or () if len(x["w"]) <= KEY or x["w"] in r}, total).split(r) for r, f in zip(runs, found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("run"), pa.array(out, pa.list_(pa.string()))], names=["run", "words"])

    return stored(runs.join(found, "id", "left").select("run", "found").mapInArrow(split, "run string, words array<string>"), "segmented")


def salted(d: DataFrame) -> DataFrame:
    """Each row once a salt, so that a frequent key of the other side is dealt to several tasks."""
    return d.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))


def featured(pages: DataFrame, words: DataFrame, rules=RULES) -> DataFrame:
    """The columns of parsed, tokens (words of the host's labels and of the path; digits by their number), and known: the tokens
    without endings."""
    d = stored(parsed(pages, rules).withColumn("row", F.monotonically_increasing_id()), "urls")
    labels = "transform(split(host, '[.]'), (x, i) -> struct('h' AS kind, i = size(split(host, '[.]')) - 1 AND (i > 0 OR ruling IS NOT NULL) AS ending, x))"
    steps = "transform(split(lower(path), '/'), (x, i) -> struct('p' AS kind, i <= 1 AS ending, x))"
    runs = f"flatten(transform(concat({labels}, {steps}), s -> transform(regexp_extract_all(s.x, '[a-z]+|[0-9]+', 0), r -> struct(s.kind, s.ending, r AS run))))"
    each = d.select("row", F.posexplode(F.expr(runs)).alias("place", "r")).select("row", "place", "r.*", F.pmod(F.col("row"), F.lit(SALTS)).cast("int").alias("salt"))
    split = salted(segmented(each.where("run >= 'a'").select("run").distinct(), words))
    own = F.coalesce("words", F.array(F.concat(F.lit("#"), F.length("run"))))
    tokens = F.transform(own, lambda w: F.concat("kind", F.lit(":"), w))
    lists = each.join(split, ["run", "salt"], "left").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", tokens.alias("t"), "ending"))).alias("t"))
    kinds = {"tokens": "flatten(t.t)", "known": "flatten(filter(t, x -> NOT x.ending).t)"}
    columns = [F.expr(f"coalesce({e}, CAST(array() AS array<string>))").alias(c) for c, e in kinds.items()]
    return stored(d.join(lists, "row", "left").select(*d.columns, *columns).drop("row"), "features")


def bucket(token: str) -> int:
    return xxhash.xxh3_64_intdigest(token) % BUCKETS


def _seeded(tokens: list[str]) -> bool:
    return any(t[:2] == "h:" and t[2:] in SEEDS for t in tokens)


@dataclass
class Filter:
    words: DataFrame
    odds: np.ndarray  # log odds of block over allow, by bucket
    threshold: float = THRESHOLD


def train(pages: DataFrame, rules=RULES) -> Filter:
    words = vocabulary(pages)
    rows = featured(pages, words, rules)
    return Filter(words, fit(rows), chosen(rows)[0])


def fit(rows: DataFrame) -> np.ndarray:
    """Log odds by bucket from the rows of featured that a rule allows or whose host holds a seed word."""
    return log_odds(_counted(rows)[0])


def held_out(rows: DataFrame):
    """Whether a row's url is one of those that choose the threshold."""
    return F.crc32(F.concat("host", "path").cast("binary")) % HELD == 0


def chosen(rows: DataFrame) -> tuple[float, dict[str, float]]:
    """(threshold on scores, figures): the threshold less the prior log odds of all training rows, and on the held-out urls the
    number of blocked and allowed training rows and the share of each judged so."""
    prior = lambda urls: math.log((urls[1] + 1) / (urls[0] + 1))
    sums, urls = _counted(rows.where(~held_out(rows)))
    odds, shift = log_odds(sums), prior(urls)

    def run(batches):
        bins = Counter()
        for batch in batches:
            for tokens, ruling in zip(batch.column("known").to_pylist(), batch.column("ruling").to_pylist(), strict=True):
                label = _label(tokens, ruling)
                if label is not None:
                    score = float(sum(odds[bucket(t)] for t in tokens)) + shift
                    bins[label, int(math.floor(min(max(score, -RANGE), RANGE) / STEP))] += 1
        rows = [(int(label), b, n) for (label, b), n in bins.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["blocked", "bin", "n"])

    least, size = int(-RANGE / STEP), int(2 * RANGE / STEP) + 1
    hist = np.zeros((2, size))
    for r in rows.where(held_out(rows)).select("known", "ruling").mapInArrow(run, "blocked long, bin long, n long").groupBy("blocked", "bin").agg(F.sum("n").alias("n")).collect():
        hist[r.blocked, r.bin - least] = r.n
    totals = hist.sum(1)
    allowed = prior(_counted(rows)[1])
    if not totals.all():
        return THRESHOLD - allowed, {"blocked": totals[1], "allowed": totals[0]}
    hit = hist[1][::-1].cumsum()[::-1] / totals[1]
    right = (hist[0].cumsum() - hist[0]) / totals[0]
    best = np.flatnonzero(hit + right == (hit + right).max())
    at = int(best[len(best) // 2])
    return (at + least) * STEP - allowed, {"blocked": totals[1], "allowed": totals[0], "blocked_right": float(hit[at]), "allowed_right": float(right[at])}


def _label(tokens: list[str], ruling: str | None) -> bool | None:
    """Whether a training row is one to block; None for a row that isn't one."""
    return True if _seeded(tokens) else False if ruling == "allow" else None


def _counted(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of the training rows by class and bucket, training rows by class), classes allow and block."""

    def run(batches):
        sums = {True: Counter(), False: Counter()}
        for batch in batches:
            for tokens, ruling in zip(batch.column("known").to_pylist(), batch.column("ruling").to_pylist(), strict=True):
                label = _label(tokens, ruling)
                if label is not None:
                    sums[label].update(map(bucket, tokens))
                    sums[label][BUCKETS] += 1  # the row itself
        rows = [(b, int(k), n) for k, c in sums.items() for b, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["bucket", "blocked", "n"])

    # at most BUCKETS + 1 rows come to the driver
    found = rows.select("known", "ruling").mapInArrow(run, "bucket long, blocked long, n long")
    sums = np.zeros((2, BUCKETS + 1))
    for r in found.groupBy("bucket").pivot("blocked", [0, 1]).agg(F.sum("n")).collect():
        sums[0, r.bucket] += r["0"] or 0
        sums[1, r.bucket] += r["1"] or 0
    return sums[:, :BUCKETS], sums[:, BUCKETS]


def log_odds(sums: np.ndarray, strength: float = SMOOTHING) -> np.ndarray:
    """log P(token | block) / P(token | allow) by token bucket, each smoothed towards the two classes together."""
    classes = sums.sum(1)
    if not classes.all():
        return np.zeros(sums.shape[1])
    base = classes / classes.sum()
    share = (sums + strength * base[:, None]) / (sums.sum(0) + strength)
    return np.log(share[1] / share[0]) - math.log(base[1] / base[0])


def judge(pages: DataFrame, model: Filter, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, and the method's log odds as score."""
    return scored(featured(pages, model.words, rules), model.odds, model.threshold)


def scored(rows: DataFrame, odds: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    def run(batches):
        for batch in batches:
            scores = [float(sum(odds[bucket(t)] for t in tokens)) for tokens in batch.column("tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    own = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return rows.mapInArrow(run, f"{kinds}, score double").select("page_id", "host", "path", "rule", F.coalesce("ruling", own).alias("verdict"), "score")


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = featured(pages, vocabulary(pages))
    return scored(rows, fit(rows), chosen(rows)[0])
