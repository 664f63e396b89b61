"""Quality rules whose cutoffs are chosen under a bound on false rejections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm._spark import WORD, durable, free_name, numbered

#: Ratios a rule may reject by when they exceed a cutoff: SQL over the metrics.
RATIOS = {
    "symbol_ratio": "n_symbols / greatest(word_chars, 1)",
    "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_ratio": "n_repeat_words / greatest(n_words, 1)",
    "shout_ratio": "n_exclaims / greatest(n_words, 1)",
}
#: A row's own number, carried beside its counts.
_ROW = "row_number"
#: Candidate cutoffs of every ratio, fixed before any label is seen.
CUTOFFS = (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7)


def _removed(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def text_metrics(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per-document counts, all inside the document's own row (no shuffle).

    Five-word windows are hashed to 64 bits; where some hash occurs twice the
    (hash, start) pairs are sorted, starts beside an equal hash are the windows
    found twice or more, and the words they cover are counted from the gaps.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), *keep, text.alias("text"))
    words = base.withColumns(
        {
            "words": F.regexp_extract_all("text", F.lit(WORD), F.lit(0)),
            "lines": F.filter(F.split("text", "\n", -1), lambda line: F.length(F.translate(line, " \t\x0b\x0c\r", "")) > 0),
        }
    ).withColumn("n_words", F.size("words").cast("long"))
    windows = words.withColumn(
        "windows",
        F.expr("case when n_words > 5 then transform(sequence(1, size(words) - 4), i -> xxhash64(words[i-1], words[i], words[i+1], words[i+2], words[i+3])) else array() end"),
    )
    ordered = windows.withColumn(
        "ordered",
        F.expr("case when size(array_distinct(windows)) < size(windows) then array_sort(transform(windows, (h, i) -> struct(h, i))) else cast(array() as array<struct<h:bigint,i:int>>) end"),
    )
    starts = ordered.withColumn(
        "starts",
        F.expr("array_sort(transform(filter(ordered, (x, j) -> (j > 0 and ordered[j-1].h = x.h) or (j < size(ordered) - 1 and ordered[j+1].h = x.h)), x -> x.i))"),
    )
    covered = F.expr("case when size(starts) = 0 then 0L else 5L + aggregate(sequence(1, size(starts)), 0L, (n, j) -> n + case when j < size(starts) then least(5, starts[j] - starts[j-1]) else 0 end) end")
    return starts.select(
        "doc_id",
        *keep,
        "n_words",
        _removed(F.col("text"), " \t\n\x0b\x0c\r").alias("n_spaces"),
        F.length("text").alias("n_chars_all"),
        _removed(F.col("text"), "#*$%&|<>").cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        _removed(F.col("text"), "!").cast("long").alias("n_exclaims"),
    ).select(
        "doc_id",
        *keep,
        "n_words",
        (F.col("n_chars_all") - F.col("n_spaces")).cast("long").alias("word_chars"),
        "n_symbols",
        "n_lines",
        "n_dup_lines",
        "n_repeat_words",
        "n_exclaims",
    )


def binomial_tail(k: str, n: str, rate: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, rate), summed exactly in logarithms."""
    return F.expr(
        f"aggregate(sequence(0, cast({k} as int)), struct({n} * ln(1 - {rate}D) as log_p, cast(0.0 as double) as total), "
        f"(acc, j) -> struct(acc.log_p + case when j < {n} then ln(({n} - j) / (j + 1.0D)) + ln({rate}D / (1 - {rate}D)) else 0.0D end as log_p, acc.total + exp(acc.log_p) as total), "
        "acc -> acc.total)"
    )


def risk_controlled_cutoffs(labelled: DataFrame, risk: float = 0.02, confidence_error: float = 0.05) -> DataFrame:
    """``(stratum, rule, cutoff)``: the strictest cutoff certified per stratum.

    ``labelled`` holds the holdout's good documents: stratum and the ratios of
    ``RATIOS``.  With n good documents of a stratum of which k exceed a cutoff,
    "more than ``risk`` of good documents are rejected" is tested by the exact
    binomial tail P(Bin(n, risk) <= k); a cutoff is certified when the tail is
    at most ``confidence_error`` over the number of tests (strata x rules x
    cutoffs, and the risk is split over the rules), so that all certified
    bounds hold at once.
    """
    per_rule = risk / len(RATIOS)
    stacked = ", ".join(f"'{r}', {r}" for r in RATIOS)
    long = labelled.selectExpr("stratum", f"stack({len(RATIOS)}, {stacked}) as (rule, ratio)")
    counts = long.groupBy("stratum", "rule").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum((F.col("ratio") > c).cast("long")).alias(f"k{j}") for j, c in enumerate(CUTOFFS)]
    )
    tests = counts.selectExpr("stratum", "rule", "n", f"stack({len(CUTOFFS)}, " + ", ".join(f"{c}D, k{j}" for j, c in enumerate(CUTOFFS)) + ") as (cutoff, k)")
    # A row per stratum, rule and cutoff: few enough for a window over all.
    place = F.dense_rank().over(Window.orderBy("stratum"))
    counted = tests.withColumn("place", place).withColumn("strata", F.max("place").over(Window.partitionBy()))
    judged = counted.withColumn("tail", binomial_tail("k", "n", per_rule))
    passed = judged.where(F.col("tail") <= F.lit(confidence_error) / (F.col("strata") * len(RATIOS) * len(CUTOFFS)))
    return passed.groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def _stratified(docs: DataFrame, stratum_col: str) -> DataFrame:
    stratum = F.coalesce(F.col(f"`{stratum_col}`").cast("string"), F.lit("")) if stratum_col in docs.columns else F.lit("")
    return docs.withColumn("stratum", stratum)


def _with_ratios(counted: DataFrame) -> DataFrame:
    return counted.withColumns({name: F.expr(sql) for name, sql in RATIOS.items()})


def _wide_cutoffs(metrics: DataFrame, labels: DataFrame, risk: float, confidence_error: float) -> DataFrame:
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    cutoffs = risk_controlled_cutoffs(metrics.join(good, "doc_id", "left_semi"), risk, confidence_error)
    return durable(cutoffs.groupBy("stratum").agg(*[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"max_{r}") for r in RATIOS]))


def _judged(metrics: DataFrame, wide: DataFrame) -> DataFrame:
    hits = F.concat_ws(",", *[F.when(F.col(r) > F.col(f"max_{r}"), F.lit(r)) for r in RATIOS])
    # A stratum certifies with hundreds of labelled documents only: few rows, and no stratum lands in one task.
    judged = metrics.join(F.broadcast(wide), "stratum", "left").withColumns({"base_failed": F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"), "rules_hit": hits})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rules_hit") == ""))


def judge_quality(
    docs: DataFrame, labels: DataFrame, risk: float = 0.02, confidence_error: float = 0.05, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang"
) -> DataFrame:
    """One row per document: id, counts, base_failed, kept, and the rules hit.

    ``base_failed`` is fewer than 10 words, or more than a fifth of the words in
    repeated five-word windows.  Other documents are rejected when a ratio
    exceeds its stratum's certified cutoff; a stratum with too few labelled good
    documents certifies none and keeps everything.  Good means quality 1 in
    every label row of the document.  The counts are written once to the shared
    folder; choosing cutoffs and judging read that narrow table.

    Of several certified cutoffs the least counts; a ratio equal to a cutoff
    does not exceed it.  Long texts are counted whole.

    Null text counts as empty.  A null stratum is a stratum.  Null ids get a
    verdict but match no label.  Repeated rows are judged separately.  No labels
    or an empty table are fine.
    """
    metrics = durable(_with_ratios(text_metrics(_stratified(docs, stratum_col), id_col, text_col, ("stratum",))))
    judged = _judged(metrics, _wide_cutoffs(metrics, labels, risk, confidence_error))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rules_hit")


def keep_quality(
    docs: DataFrame, labels: DataFrame, risk: float = 0.02, confidence_error: float = 0.05, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang"
) -> DataFrame:
    """The rows of ``docs`` that :func:`judge_quality` keeps, columns unchanged.

    Texts are counted once; the counts are written with a row number, and choosing
    cutoffs and judging read them alone.  The rows kept are found again by their
    number, which no stratum crowds, and no copy of the texts is left behind for
    documents that lie in Parquet files.  Nulls, ties and empty tables as there.
    """
    row = free_name(docs, "row")
    keyed = numbered(docs, row)
    stratum = (stratum_col,) if stratum_col in docs.columns else ()
    rows = keyed.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), *[F.col(f"`{c}`") for c in stratum], F.col(f"`{row}`").alias(_ROW))
    metrics = durable(_with_ratios(text_metrics(_stratified(rows, stratum_col), id_col, text_col, ("stratum", _ROW))))
    kept = _judged(metrics, _wide_cutoffs(metrics, labels, risk, confidence_error)).where("kept").select(F.col(_ROW).alias(row))
    return keyed.join(kept, row, "left_semi").select(docs.columns)
