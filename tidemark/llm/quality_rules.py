"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Each rule scores a document (higher is worse) and rejects it above a cutoff of its stratum. Cutoffs are certified on a
labelled holdout: they are valid only if an exact binomial bound shows, jointly for all rules and corrected for the
number of strata, that they reject no more than a set share of good documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import BLANKS, let, materialize, table

SYMBOLS = "#*$%&|<>"
#: Name of a rule and its score from the statistics of text_stats.
RULES: dict[str, Column | str] = {
    "symbols": "n_symbols / greatest(word_chars, 1L)",
    "capitals": "n_capitals / greatest(word_chars, 1L)",
    "exclaims": "n_exclaims / greatest(n_words, 1L)",
    "long_words": "word_chars / greatest(n_words, 1L)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1L)",
    "repeats": "n_repeat_words / greatest(n_words, 1L)",
}
#: Steps above the largest good score of the choosing half that are tried as cutoffs, from the mildest, as shares of its
#: distance to the bad documents' upper scores; rules whose bad documents don't lie further above it than it lies above
#: the median of the good reject nothing there.
MARGINS = (1.0, 0.75, 0.5, 0.35, 0.25, 0.15, 0.1, 0.05)
#: The quantile that stands for the bad documents' upper scores.
BAD_UPPER = 0.95
#: Upper quantiles of the good documents of the choosing half that are tried next, from the mildest.
QUANTILES = (1.0, 0.9995, 0.999, 0.9975, 0.995, 0.9925, 0.99, 0.985, 0.98, 0.97, 0.96, 0.95)


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found at least twice: windows are sorted by hash, then by their words, so
    equal ones are neighbours; the places of repeated ones are spread over their three words and counted once."""
    key = lambda w, i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.alias("i"))
    same = lambda x, y: (x.h == y.h) & (x.a == y.a) & (x.b == y.b) & (x.c == y.c)
    rest = lambda s: F.filter(s, lambda x, k: F.coalesce(same(x, F.get(s, k - 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, k + 1)), F.lit(False)))
    spread = lambda s: F.size(F.array_distinct(F.flatten(F.transform(rest(s), lambda x: F.array(x.i, x.i + 1, x.i + 2)))))
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: key(words, i))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(F.sort_array(windows), spread)).cast("long")


def text_stats(text: Column) -> Column:
    """A struct of counts over a whole text; null and empty texts give zeros (and one line)."""
    t = F.coalesce(text, F.lit(""))
    count_of = lambda chars: (F.char_length(t) - F.char_length(F.translate(t, chars, ""))).cast("long")
    lines = F.split(t, "\n")
    full = lambda ls: F.filter(ls, lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    return F.struct(
        let(
            F.array_remove(F.split(t, "[\\t-\\r ]+"), ""),
            lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words")),
        ).alias("w"),
        F.char_length(F.translate(t, BLANKS, "")).cast("long").alias("word_chars"),
        count_of(SYMBOLS).alias("n_symbols"),
        let(full(lines), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        F.size(lines).cast("long").alias("n_lines"),
        count_of("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_capitals"),
        count_of("!").alias("n_exclaims"),
    )


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), summed in logarithms; 1 without summing where k >= n p, as no test passes there."""
    first = n * F.log1p(F.lit(-p))
    step = lambda acc, i: let(
        acc.t + F.ln((n - i + 1) / i) + F.ln(F.lit(p / (1 - p))),
        lambda t: let(F.greatest(acc.s, t), lambda m: F.struct(t.alias("t"), (m + F.ln(F.exp(acc.s - m) + F.exp(t - m))).alias("s"))),
    )
    ks = F.when(k < 1, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(1).cast("bigint"), k))
    total = F.aggregate(ks, F.struct(first.alias("t"), first.alias("s")), step, lambda a: F.exp(a.s))
    return F.when(n < 1, F.lit(1.0)).when(k >= n * p, F.lit(1.0)).otherwise(total)


def certified_cutoffs(scored: DataFrame, labels: DataFrame, rules: list[str], alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """(stratum, rule, cutoff): the certified cutoffs. scored: doc_id, stratum, a column for each rule.

    Labelled rows are split in two halves by a hash of doc_id. The choosing half makes a path of joint cutoffs for each
    stratum: at each step, every rule that tells its bad from its good documents at all has the step's margin above the
    largest good score as cutoff (none, where bad documents don't lie well above it), and later the step's upper quantile of
    the good ones, so that what any rule rejects only grows along the path from a joint cutoff that is mild: each rule's
    largest good score is passed by about one good document of a holdout of equal size, so that a union of rules needs to
    begin above it. The holdout half tests the
    path as a whole: with k of n good documents rejected by any rule, "more than alpha of the good are rejected" is
    refused if P(Bin(n, alpha) <= k) <= delta / strata, the exact (Clopper-Pearson) bound with Bonferroni's correction
    over strata. Steps are tested in a fixed sequence from the mildest up to the first that fails, which needs no
    correction, nor do rules, as one joint rejection is tested: about 85 good rows with none rejected certify alpha =
    0.05 in four strata. So with probability 1 - delta no stratum loses more than alpha of the good documents that were
    scored (judge scores those that pass the base). Of the certified steps that one is taken that parts the choosing
    half's bad from its good documents best, the mildest of equals; without gain, or with too few labels, none.
    """
    steps = len(MARGINS) + len(QUANTILES)
    marked = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__id")).agg(F.min("quality").alias("good"))
    both = scored.join(marked, F.col("doc_id") == F.col("__id")).withColumn("holdout", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 1)
    both = materialize(both.select("stratum", "good", "holdout", *rules), "rule-scores")
    quantile = lambda r, good, q: F.percentile_approx(F.when(F.col("good") == good, F.col(r)), q, 10000)
    known = both.where("NOT holdout").groupBy("stratum").agg(*[x for r in rules for x in (quantile(r, 1, [*map(float, QUANTILES), 0.5]).alias(f"good_{r}"), quantile(r, 0, BAD_UPPER).alias(f"bad_{r}"))])

    def path(r):
        largest, median, far = F.get(f"good_{r}", F.lit(0)), F.get(f"good_{r}", F.lit(len(QUANTILES))), F.col(f"bad_{r}")
        above = [F.when(far - largest > largest - median, largest + m * (far - largest)).otherwise(F.lit(float("inf"))) for m in MARGINS]
        return F.concat(F.array(*above), F.slice(f"good_{r}", 1, len(QUANTILES)))

    tried = known.where(F.col(f"good_{rules[0]}").isNotNull()).select("stratum", *[path(r).alias(f"q_{r}") for r in rules])
    tried = materialize(tried, "rule-cutoffs")
    place = lambda r: F.array_position(F.transform(f"q_{r}", lambda q: F.col(r) > q), True)
    first = lambda r: F.when(place(r) > 0, place(r) - 1).otherwise(F.lit(steps))
    met = materialize(both.join(tried, "stratum").select("stratum", "good", "holdout", F.array(*[F.struct(F.lit(r).alias("rule"), first(r).alias("first")) for r in rules]).alias("firsts")), "rule-steps")
    fine, bad = (F.col("good") == 1) & ~F.col("holdout"), (F.col("good") == 0) & ~F.col("holdout")
    rate = lambda of, at: F.count_if(of & at) / F.greatest(F.count_if(of), F.lit(1))
    gains = lambda at: F.array(*[rate(bad, at <= k) - rate(fine, at <= k) for k in range(steps)])
    useful = met.select("stratum", "good", "holdout", F.explode("firsts").alias("x")).groupBy("stratum", "x.rule").agg(gains(F.col("x.first")).alias("g")).where(F.array_max("g") > 0)
    useful = materialize(useful.groupBy("stratum").agg(F.collect_set("rule").alias("used")), "rule-choice")
    joint = met.join(useful, "stratum").select("stratum", "good", "holdout", F.array_min(F.transform(F.filter("firsts", lambda x: F.array_contains("used", x.rule)), lambda x: x.first)).alias("first"))
    held = (F.col("good") == 1) & F.col("holdout")
    counts = joint.groupBy("stratum").agg(F.count_if(held).alias("n"), F.array(*[F.count_if(held & (F.col("first") <= k)) for k in range(steps)]).alias("k"), gains(F.col("first")).alias("gain"))
    counts = materialize(counts, "rule-counts")
    strata = max(1, counts.count())
    path = counts.select("stratum", "n", F.posexplode(F.arrays_zip("k", "gain")).alias("step", "x")).select("stratum", "step", "x.gain", (binomial_cdf(F.col("x.k"), F.col("n"), alpha) <= delta / strata).alias("ok"))
    order = Window.partitionBy("stratum").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    best = path.withColumn("ok", F.min("ok").over(order)).where("ok AND gain > 0").groupBy("stratum").agg(F.max_by("step", F.struct("gain", -F.col("step"))).alias("step"))
    cutoffs = F.array(*[F.struct(F.lit(r).alias("rule"), F.get(f"q_{r}", F.col("step")).alias("cutoff")) for r in rules])
    out = best.join(tried, "stratum").join(useful, "stratum").select("stratum", "used", F.explode(cutoffs).alias("x"))
    return out.where(F.array_contains("used", F.col("x.rule"))).select("stratum", "x.rule", "x.cutoff")


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """doc_id, the statistics, base_failed, kept and failed_rules (array of the rules above their cutoff) of every row.

    Null texts count as empty ones, which fail the base; a null stratum is the stratum "". Rows that repeat a doc_id are
    judged each, and count each where they are labelled; of different labels of an id the smaller counts. Without
    labels, or with none that match, only the base rejects. Further columns of docs and labels are not looked at,
    whatever they are called.
    """
    t = docs.select("doc_id", F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), text_stats(F.col("text")).alias("s"))
    t = t.select("doc_id", "stratum", "s.w.*", "s.word_chars", "s.n_symbols", "s.n_dup_lines", "s.n_lines", "s.n_capitals", "s.n_exclaims")
    t = t.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    stats = materialize(t.select("*", *[F.expr(e).cast("double").alias(r) for r, e in RULES.items()]), "text-stats")
    rules = list(RULES)
    cuts = certified_cutoffs(stats.where("NOT base_failed").select("doc_id", "stratum", *rules), labels, rules, alpha, delta)
    wide = materialize(cuts.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cuts")), "rule-cuts")
    failed = F.filter(F.array(*[F.when(F.col(r) > F.try_element_at(F.col("cuts"), F.lit(r)), F.lit(r)) for r in rules]), lambda x: x.isNotNull())
    out = stats.join(wide, "stratum", "left").withColumn("failed_rules", failed)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"), F.array_join("failed_rules", ",").alias("failed_rules"),
    )


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
