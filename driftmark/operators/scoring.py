"""Field comparison, record status, error classes and the metrics over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark.functions import special
from driftmark.functions import text as T

OUTCOMES = ("TP", "TN", "FP", "FN", "MISMATCH")


def compare(pred: Column, truth: Column) -> Column:
    """TP, TN, FP (nothing was there), FN (nothing was given) or MISMATCH, of comparable values."""
    p, t = T.blank(pred), T.blank(truth)
    return F.when((t == "") & (p == ""), "TN").when(p == t, "TP").when(t == "", "FP").when(p == "", "FN").otherwise("MISMATCH")


def compare_fields(pred: Column, truth: Column, fields=T.FIELDS) -> Column:
    """A struct of the outcomes of each field of two structs, after normalisation.

    All values go through one normalising expression, each once, so the plan holds that expression once.
    """
    keys = F.transform(F.array(*[side[f] for side in (pred, truth) for f in fields]), lambda x: T.comparable(x))
    return T.let(keys, lambda k: F.struct(*[compare(k[i], k[len(fields) + i]).alias(f) for i, f in enumerate(fields)]))


def _count(outcome: Column, fields, *kinds: str) -> Column:
    return reduce(lambda a, b: a + b, [outcome[f].isin(*kinds).cast("int") for f in fields])


def record_status(outcome: Column, fields, truth_fields: Column) -> Column:
    """CORRECT, PARTIAL (at least two fields right) or ERROR."""
    tp, fp = _count(outcome, fields, "TP"), _count(outcome, fields, "FP", "MISMATCH")
    none = F.when(fp == 0, "CORRECT").otherwise("ERROR")
    some = F.when((tp == truth_fields) & (fp == 0), "CORRECT").when(tp >= 2, "PARTIAL").otherwise("ERROR")
    return F.when(truth_fields == 0, none).otherwise(some)


def error_class(status: Column, outcome: Column, fields, scenario: Column, raw: Column, ward: str = "PhuongXa", marks=("P.", "Q.", "TP.")) -> Column:
    """none, or the first error class that applies."""
    pure_fp, fn, tp = _count(outcome, fields, "FP"), _count(outcome, fields, "FN", "MISMATCH"), _count(outcome, fields, "TP")
    wrong = scenario.isin("A", "D") & (outcome[ward] == "MISMATCH") if ward in fields else F.lit(False)
    short = reduce(lambda a, b: a | b, [raw.contains(m) for m in marks])
    return F.when(status == "CORRECT", "none").when(pure_fp > 0, "hallucination_over_imputation").when(wrong, "wrong_target").when((fn > 0) & (tp > 0), "missing_field").when(short, "abbreviation_misunderstood").otherwise("parse_boundary_error")


#: What a record's note says of each error class.
NOTES = {
    "hallucination_over_imputation": "Tự điền trường không có trong nguồn: ",
    "wrong_target": "Sai đích phường/xã",
    "missing_field": "Bỏ sót thành phần địa chỉ có trong chuỗi",
    "abbreviation_misunderstood": "Không nhận diện được từ viết tắt tiếng Việt",
    "parse_boundary_error": "Cắt sai biên hoặc gán sai vai trò thực thể",
}


def note(error: Column, outcome: Column, fields, extra: Column | None = None) -> Column:
    """The note of a record: ``extra``, and for an error a bar and what the class says, with the fields that were made up."""
    extra = T.blank(extra) if extra is not None else F.lit("")
    made_up = F.array_join(F.filter(F.array(*[F.when(outcome[f] == "FP", F.lit(f)) for f in fields]), lambda x: x.isNotNull()), ", ")
    said = F.create_map(*[F.lit(x) for kv in NOTES.items() for x in kv])[error]
    names = F.when(error == "hallucination_over_imputation", made_up).otherwise("")
    return F.when(error == "none", extra).otherwise(F.concat(extra, F.lit("|"), said, names))


def score(df: DataFrame, pred: str = "pred", truth: str = "truth", scenario: str = "scenario", raw: str = "raw", fields=T.FIELDS) -> DataFrame:
    """df with outcome (struct), status, error, field_code and note.

    The outcome is bound once; one expression over it binds the status and the error.
    So neither a later rule nor a filter that Catalyst pushes below the columns compares the fields
    over again, and who needs outcomes alone does not pay for the rest.
    """
    given = F.size(F.filter(F.array(*[F.col(truth)[f] for f in fields]), lambda x: T.clean_value(x) != ""))

    def rest(b):
        return T.let(record_status(b["o"], fields, b["given"]), lambda s: F.struct(s.alias("status"), error_class(s, b["o"], fields, F.col(scenario), F.col(raw)).alias("error")))

    out = df.withColumn("outcome", compare_fields(F.col(pred), F.col(truth), fields))
    out = out.withColumn("dm_scored", T.let(F.struct(F.col("outcome").alias("o"), given.alias("given")), rest)).withColumns({c: F.col(f"dm_scored.{c}") for c in ("status", "error")}).drop("dm_scored")
    return out.withColumns({"field_code": field_code(F.col("outcome"), T.FIELDS, fields), "note": note(F.col("error"), F.col("outcome"), fields)})


def field_code(outcome: Column, every, scored) -> Column:
    """A character for each field: n not scored, t both empty, m match, o omitted, x anything else."""
    letter = lambda f: F.when(outcome[f] == "TN", "t").when(outcome[f] == "TP", "m").when(outcome[f] == "FN", "o").otherwise("x") if f in scored else F.lit("n")
    return F.concat(*[letter(f) for f in every])


def long_outcomes(df: DataFrame, keys: list[str], fields=T.FIELDS, outcome: str = "outcome") -> DataFrame:
    """(keys, field, result), a row for each field."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(outcome)[f].alias("result")) for f in fields]))
    return df.select(*keys, each.alias("r")).select(*keys, "r.field", "r.result")


def ratio(a: Column, b: Column, zero: float | None = 0.0) -> Column:
    """a / b as double; ``zero`` where b is 0 (None: null)."""
    return F.when(b != 0, a.cast("double") / b.cast("double")).otherwise(F.lit(zero).cast("double"))


def confusion(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """tp, tn, fp, fn by keys; a MISMATCH is one false positive and one false negative."""
    r = F.col("result")
    return outcomes.groupBy(*keys).agg(F.count_if(r == "TP").alias("tp"), F.count_if(r == "TN").alias("tn"), F.count_if(r.isin("FP", "MISMATCH")).alias("fp"), F.count_if(r.isin("FN", "MISMATCH")).alias("fn"), F.count("*").alias("n"))


def field_metrics(counts: DataFrame, zero: float | None = 0.0) -> DataFrame:
    """Counts with precision, recall, f1 (``zero`` on zero denominators) and accuracy."""
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return counts.withColumns({"precision": ratio(tp, tp + fp, zero), "recall": ratio(tp, tp + fn, zero), "f1": ratio(2 * tp, 2 * tp + fp + fn, zero), "accuracy": ratio(tp + F.col("tn"), F.col("n"))})


def micro_f1(outcomes: DataFrame, keys: list[str], zero: float | None = None) -> DataFrame:
    """Micro F1 by keys over all fields; ``zero`` on a zero denominator."""
    c = confusion(outcomes, keys)
    return c.select(*keys, ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"), zero).alias("micro_f1"))


def macro_f1(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over fields of F1; a field that never occurs counts as 0."""
    per = field_metrics(confusion(outcomes, [*keys, "field"]))
    return per.groupBy(*keys).agg(F.avg("f1").alias("macro_f1"))


def status_rates(df: DataFrame, keys: list[str]) -> DataFrame:
    """total and the counts and rates of the four statuses."""
    s = F.col("status")
    names = {"correct": "CORRECT", "partial": "PARTIAL", "error": "ERROR", "unsupported": "UNSUPPORTED"}
    out = df.groupBy(*keys).agg(F.count("*").alias("total"), *[F.count_if(s == v).alias(k) for k, v in names.items()])
    return out.withColumns({f"{k}_rate": ratio(F.col(k), F.col("total")) for k in names})


def error_histogram(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, error, n, share) of each error class."""
    from pyspark.sql import Window as W

    n = df.groupBy(*keys, "error").agg(F.count("*").alias("n"))
    return n.withColumn("share", ratio(F.col("n"), F.sum("n").over(W.partitionBy(*keys))))


def wald_interval(p: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """The Wald interval of a rate, cut to [0, 1]."""
    half = F.lit(z) * F.sqrt(p * (1 - p) / n)
    return F.greatest(F.lit(0.0), p - half), F.least(F.lit(1.0), p + half)


def wilson_interval(p: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson's interval of a rate."""
    mid, den = p + z * z / (2 * n), 1 + z * z / n
    half = F.lit(z) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (mid - half) / den, (mid + half) / den


def mcnemar(df: DataFrame, a: str, b: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """The paired 2 x 2 table of two Boolean columns, for each of the keys, and the continuity-corrected statistic."""
    x, y = F.col(a), F.col(b)
    t = df.groupBy(*keys).agg(F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"), F.count_if(~x & ~y).alias("neither"))
    d = F.col("only_a") + F.col("only_b")
    stat = F.when(d > 0, F.pow(F.abs(F.col("only_a") - F.col("only_b")) - 1, F.lit(2)) / d).otherwise(F.lit(0.0))
    return t.withColumn("statistic", stat)


def with_p_value(df: DataFrame, column: str = "statistic") -> DataFrame:
    """df with p_value of a chi-square statistic of one degree of freedom."""
    return df.withColumn("p_value", special.chi_square_tail(F.col(column)))


def missing_and_hallucination(df: DataFrame, keys: list[str]) -> DataFrame:
    """Shares of records that miss a field and of those that make one up."""
    share = lambda e: ratio(F.count_if(F.col("error") == e), F.count("*"))
    return df.groupBy(*keys).agg(share("missing_field").alias("missing_rate"), share("hallucination_over_imputation").alias("hallucination_rate"))


def recovery(df: DataFrame, keys: list[str], kind: str, pred: Column, truth: Column) -> DataFrame:
    """correct, wrong and empty predictions by keys and kind, with a row of all kinds (kind null) for each key."""
    p, t = T.blank(pred), T.blank(truth)
    what = F.when(p == "", "empty").when(p == t, "correct").otherwise("wrong")
    tagged = df.withColumn("dm_w", what)
    counts = [F.count_if(F.col("dm_w") == w).alias(w) for w in ("correct", "wrong", "empty")]
    return tagged.groupingSets([[*[F.col(k) for k in keys], F.col(kind)], [F.col(k) for k in keys]], *keys, kind).agg(*counts, F.count("*").alias("n"))


def flips(df: DataFrame, level: str, clean: str, noisy: str) -> DataFrame:
    """By level and for all (level null): exact counts of both sides, right-to-wrong and wrong-to-right flips."""
    c, n = F.col(clean), F.col(noisy)
    return df.rollup(level).agg(F.count("*").alias("n"), F.count_if(c).alias("clean_exact"), F.count_if(n).alias("noisy_exact"), F.count_if(c & ~n).alias("flips"), F.count_if(~c & n).alias("reverse_flips"))


def by_label(df: DataFrame, labels: Column, exact: str) -> DataFrame:
    """(label, n, exact) over an array of labels: a row counts for each of its labels."""
    return df.select(F.explode(labels).alias("label"), exact).groupBy("label").agg(F.count("*").alias("n"), F.count_if(exact).alias("exact"))
