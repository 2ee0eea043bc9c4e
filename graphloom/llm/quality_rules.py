"""Quality rules: a threshold table compiled into one Spark projection.

Every metric is a built-in expression, so the whole operator is a scan with a projection: no shuffle, no user function.
Null or empty texts have no words, all counts 0 and fail the base rule. Repeated rows are judged alike, each on its own. Texts are
judged whole; an empty table gives no rows. Only the two named columns are read, so others may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Very common words of the four languages of the corpus (fixed values).
STOP_WORDS = (
    "the of and to in is that for it as was with be by on he this are or his from at which but have an had they you were "
    "der die das und in den von zu mit ist des im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei "
    "le la les de des et un une du en que qui dans pour par sur pas il au avec plus son ce se elle "
    "el los las y que del en un una por con no su para es al lo como se más o"
).split()


@dataclass(frozen=True)
class Rule:
    """metric must lie in [least, most]; None leaves a side open."""

    metric: str
    least: float | None
    most: float | None


#: The production table. Ratios are per word, character or line as METRICS says.
RULES = (
    Rule("n_words", 10, 200_000),
    Rule("mean_word_chars", 2.0, 14.0),
    Rule("symbol_word_ratio", None, 0.3),
    Rule("shout_ratio", None, 0.5),
    Rule("pipe_word_ratio", None, 0.25),
    Rule("stop_word_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.5),
    Rule("alpha_char_ratio", 0.5, None),
)


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the words and the raw counts that the metrics divide. Repeated windows are found by sorting window hashes
    with their places, n log n in the words of one text."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumn("_t", t)
    d = d.withColumn("_w", F.filter(F.split("_t", "[\\x20\\x09-\\x0D]+"), lambda x: x != ""))
    d = d.withColumn("n_words", F.size("_w").cast("long"))
    d = d.withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0))
    return d.withColumn("_at", _repeated_windows())


def _repeated_windows() -> Column:
    """Places, in order, of the 5-word windows that occur twice or more."""
    return F.expr(
        """CASE WHEN n_words < 6 THEN array() ELSE
             transform(array(sort_array(transform(sequence(0, CAST(n_words AS INT) - 5),
               i -> named_struct('h', xxhash64(_w[i], _w[i + 1], _w[i + 2], _w[i + 3], _w[i + 4]), 'i', i)))),
             s -> sort_array(transform(filter(transform(s, (x, k) -> named_struct('i', x.i,
               'r', (k > 0 AND get(s, k - 1).h = x.h) OR coalesce(get(s, k + 1).h = x.h, false))), x -> x.r), x -> x.i)))[0] END"""
    )


#: Metrics of the table, over the columns of with_counts and _with_measures.
METRICS: dict[str, str] = {
    "n_words": "n_words",
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "symbol_word_ratio": "n_symbol_words / greatest(n_words, 1)",
    "shout_ratio": "n_shout_words / greatest(n_words, 1)",
    "pipe_word_ratio": "n_pipe_words / greatest(n_words, 1)",
    "stop_word_ratio": "n_stop_words / greatest(n_words, 1)",
    "dup_line_ratio": "n_dup_lines / greatest(size(_lines), 1)",
    "alpha_char_ratio": "n_alpha / greatest(word_chars, 1)",
}


def _with_measures(d: DataFrame) -> DataFrame:
    stop = F.array(*[F.lit(w) for w in dict.fromkeys(STOP_WORDS)])
    return d.withColumns(
        {
            "word_chars": F.length(F.translate("_t", " \t\n\x0b\x0c\r", "")).cast("long"),
            "n_symbols": _count(F.col("_t"), "#*$%&|<>").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.expr(
                "aggregate(_at, named_struct('n', 0L, 'p', -5), (a, i) -> named_struct('n', a.n + least(5, i - a.p), 'p', i), a -> a.n)"
            ),
            "n_symbol_words": F.size(F.filter("_w", lambda x: x.rlike("[#*$%&<>]"))),
            "n_shout_words": F.size(F.filter("_w", lambda x: (x == F.upper(x)) & (x != F.lower(x)) & (F.length(x) > 1))),
            "n_pipe_words": F.size(F.filter("_w", lambda x: x == "|")),
            "n_stop_words": F.size(F.filter("_w", lambda x: F.lower(x).isin(list(dict.fromkeys(STOP_WORDS))))),
            "n_alpha": F.length(F.regexp_replace("_t", "[^\\p{L}]+", "")),
        }
    )


def compile_rules(rules=RULES) -> Column:
    """The table as one boolean expression over METRICS."""
    verdict = F.lit(True)
    for r in rules:
        value = F.expr(METRICS[r.metric])
        if r.least is not None:
            verdict = verdict & (value >= r.least)
        if r.most is not None:
            verdict = verdict & (value <= r.most)
    return verdict


def judge(docs: DataFrame, rules=RULES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, the counts, base_failed and kept for each row of docs; other columns of docs are not carried."""
    d = with_counts(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), "text")
    d = _with_measures(d)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & compile_rules(rules)).alias("kept"),
    )


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
