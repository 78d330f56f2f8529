"""Quality rules with thresholds that follow the data: quantile sketches for each language and source.

Everything is DataFrame expressions. A sketch is a histogram whose buckets have a width of at most 1/32 of their value;
sketches of any parts of the data merge by adding counts, so the result depends on neither partitions nor order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import stage

_BLANKS = " \t\n\x0b\f\r"
_WINDOW = 5
#: Metrics with the most thousandths of a group's accepted documents that its threshold may reject on a side. Metrics are
#: whole numbers: hundredths of a character for the mean word length, else thousandths.
METRICS = {"word_length": 100, "symbol_share": 100, "dup_line_share": 10, "repeat_share": 10}
#: Metrics that have a lower threshold as well.
TWO_SIDED = ("word_length",)
LEAST_ROWS = 50
REACH = 3
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "base_failed")


def _tokens(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(_BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+", -1))


def base_features(df: DataFrame, text_col: str = "text", min_words: int = 10, max_repeat_percent: int = 20) -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and base_failed appended.

    One projection without shuffle. Repeated windows are found by sorting a document's window hashes, so a text that
    repeats throughout costs no more than its length times the logarithm.
    """
    _refuse(df, FEATURES)
    own = ["row"]  # all columns of the caller travel in one, so that none can bear the name of a step's
    text = F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))
    split = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")).select("*", _tokens(text).alias("_words"), F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(_BLANKS)) != "").alias("_lines"))
    counted = split.select(
        *own, F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_words") >= _WINDOW, F.transform(
            F.sequence(F.lit(1), F.size("_words") - (_WINDOW - 1)),
            lambda i: F.xxhash64(*(F.element_at("_words", i + k) for k in range(_WINDOW))))).alias("_windows"))
    ordered = counted.select("*", F.when(
        F.size(F.array_distinct("_windows")) < F.size("_windows"),
        F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))).alias("_sorted"))
    found = F.filter("_sorted", lambda x, i: (
        ((i > 0) & (F.get("_sorted", i - 1)["h"] == x["h"])) | F.coalesce(F.get("_sorted", i + 1)["h"] == x["h"], F.lit(False))))
    places = F.sort_array(F.transform(found, lambda x: x["at"]))
    covered = F.aggregate(
        places, F.struct(F.lit(-_WINDOW).alias("last"), F.lit(0).cast("long").alias("total")),
        lambda a, at: F.struct(at.alias("last"), (a["total"] + F.least(F.lit(_WINDOW), at - a["last"])).alias("total")),
        lambda a: a["total"])
    result = ordered.select(*own, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "n_lines")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return result.select("row.*", *FEATURES[:-1], failed.alias("base_failed"))


def _refuse(df: DataFrame, added: tuple[str, ...]) -> None:
    clash = set(added) & {c.lower() for c in df.columns}
    if clash:
        raise ValueError(f"columns already there: {sorted(clash)}")


def metrics() -> dict[str, Column]:
    """Whole-number metrics of a document; 0 where there is nothing to divide by."""
    def share(part: str, whole: str, scale: int) -> Column:
        return F.when(F.col(whole) > 0, F.floor(F.expr(f"{scale} * {part} div {whole}"))).otherwise(F.lit(0)).cast("long")

    return {"word_length": share("word_chars", "n_words", 100), "symbol_share": share("n_symbols", "word_chars", 1000),
            "dup_line_share": share("n_dup_lines", "n_lines", 1000), "repeat_share": share("n_repeat_words", "n_words", 1000)}


def _bucket(value: Column) -> Column:
    """Values below 64 have buckets of their own; above, 32 buckets between two powers of two."""
    bits = F.length(F.bin(value)) - 6
    return F.when(value < 64, value).otherwise(bits * 32 + F.floor(value / F.pow(F.lit(2.0), bits))).cast("long")


def _bottom(bucket: Column) -> Column:
    """The smallest value of a bucket."""
    bits = F.floor(bucket / 32) - 1
    return F.when(bucket < 64, bucket).otherwise((bucket - bits * 32) * F.pow(F.lit(2.0), bits)).cast("long")


def _top(bucket: Column) -> Column:
    """The largest value of a bucket."""
    bits = F.floor(bucket / 32) - 1
    return F.when(bucket < 64, bucket).otherwise((bucket - bits * 32 + 1) * F.pow(F.lit(2.0), bits) - 1).cast("long")


def thresholds(features: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """For each language and source the largest (``most_``) and, where two-sided, the least (``least_``) accepted value.

    Both come from the group's own sketch. The fence is the third quartile and ``REACH`` times the quartile distance, or
    the quantile beyond which only the metric's share of the group lies (``METRICS``), if that is higher; below, alike.
    The threshold is put halfway between the last bucket inside the fence and the first one outside. No number enters that
    does not come from the group, so a group of equal values rejects what differs, but never more than the share.

    The sketches merge upwards: a group of fewer than ``LEAST_ROWS`` accepted documents takes its language's sketch, a
    language that small the sketch of all. Documents that fail the base rules are left out of the sketches. Null
    languages and sources are groups like others.
    """
    rows = features.filter(~F.col("base_failed")).select(
        F.col(lang_col).alias("lang"), F.col(source_col).alias("source"),
        F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), _bucket(v).alias("bucket")) for n, v in metrics().items()))).alias("m"))
    sketch = stage(rows.groupBy("lang", "source", "m.metric", "m.bucket").agg(F.count("*").alias("n")), "sketch")
    ends = [f"most_{n}" for n in METRICS] + [f"least_{n}" for n in TWO_SIDED]

    def fences(keys: list[str]) -> DataFrame:
        merged = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
        group = Window.partitionBy(*keys, "metric")
        upto, total, top, bottom = F.col("upto"), F.col("total"), F.col("top"), F.col("bottom")
        ranked = merged.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("total", F.sum("n").over(group)).select(
            "*", _top(F.col("bucket")).alias("top"), _bottom(F.col("bucket")).alias("bottom"))
        share = F.coalesce(*(F.when(F.col("metric") == n, F.lit(v)) for n, v in METRICS.items()))
        at = {"q1": F.min(F.when(4 * upto >= total, top)), "q3": F.min(F.when(4 * upto >= 3 * total, top)),
              "high": F.min(F.when(1000 * upto >= (1000 - share) * total, top)),
              "low": F.min(F.when(1000 * upto > share * total, bottom))}
        placed = ranked.select("*", *(c.over(group).alias(name) for name, c in at.items()))
        distance = REACH * (F.col("q3") - F.col("q1"))
        placed = placed.withColumn("above", F.greatest(F.col("q3") + distance, "high")).withColumn("below", F.least(F.col("q1") - distance, "low"))
        found = placed.groupBy(*keys, "metric").agg(
            F.max("total").alias("rows"), F.max("above").alias("above"), F.max("below").alias("below"),
            F.max(F.when(top <= F.col("above"), top)).alias("last"), F.min(F.when(top > F.col("above"), bottom)).alias("next"),
            F.min(F.when(bottom >= F.col("below"), bottom)).alias("first"), F.max(F.when(bottom < F.col("below"), top)).alias("before"))
        most = F.coalesce(F.floor((F.col("last") + F.col("next") - 1) / 2), F.col("above")).cast("long")
        least = F.coalesce(F.floor((F.col("first") + F.col("before")) / 2) + 1, F.col("below")).cast("long")
        value = {f"most_{n}": F.max(F.when(F.col("metric") == n, most)) for n in METRICS}
        value |= {f"least_{n}": F.max(F.when(F.col("metric") == n, least)) for n in TWO_SIDED}
        return found.groupBy(*keys).agg(F.max("rows").alias("rows"), *(c.alias(name) for name, c in value.items()))

    def renamed(df: DataFrame, mark: str, keys: list[str]) -> DataFrame:
        enough = F.lit(mark == "all") | (F.col("rows") >= LEAST_ROWS)
        return df.select(*(F.col(k).alias(f"{mark}_{k}") for k in keys), *(F.when(enough, F.col(n)).alias(f"{mark}_{n}") for n in ends))

    own, by_lang, overall = fences(["lang", "source"]), renamed(fences(["lang"]), "up", ["lang"]), renamed(fences([]), "all", [])
    joined = own.join(by_lang, own["lang"].eqNullSafe(by_lang["up_lang"]), "left").join(F.broadcast(overall), F.lit(True), "left")  # one row
    return joined.select("lang", "source", *(
        F.coalesce(F.when(F.col("rows") >= LEAST_ROWS, F.col(n)), F.col(f"up_{n}"), F.col(f"all_{n}")).alias(n) for n in ends))


def judge(features: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``features`` (already stored: it is read twice) with ``kept``: no base rule failed, no metric beyond its threshold.

    The thresholds are stored, so Spark knows their size and broadcasts them only below its own limit; above, it joins
    by sorting, where adaptive execution splits a hot group. A group without accepted documents has no threshold and
    no document to hold against it.
    """
    limits = stage(thresholds(features, lang_col, source_col), "thresholds").withColumnsRenamed({"lang": "_lang", "source": "_source"})
    joined = features.join(limits, features[lang_col].eqNullSafe(limits["_lang"]) & features[source_col].eqNullSafe(limits["_source"]), "left")
    within = F.lit(True)
    for name, value in metrics().items():
        within = within & (value <= F.coalesce(F.col(f"most_{name}"), F.lit(0)))
        if name in TWO_SIDED:
            within = within & (value >= F.coalesce(F.col(f"least_{name}"), F.lit(0)))
    return joined.withColumn("kept", ~F.col("base_failed") & within).select(*features.columns, "kept")


def judged_rows(df: DataFrame, columns: list[str], text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``carried`` (a struct of ``columns``), the features and ``kept`` of every row; texts are read once.

    The features are stored and judged. Columns of any name can be carried. A null text has no words and fails.
    Repeated rows are judged alike. An empty table gives no row.
    """
    named = df.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("carried"), F.col(f"`{text_col}`").alias("text"),
                      F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{source_col}`").alias("source"))
    return judge(stage(base_features(named).drop("text"), "features"))


def quality_rules(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", carry: bool = False,
                  id_col: str = "doc_id") -> DataFrame:
    """Features and verdict of every document; ``carry`` keeps all columns of ``df``, else id, language and source stay.

    With ``carry`` columns of ``df`` that bear the names of features or ``kept`` are an error of the caller and raise; to
    filter such a table use :func:`keep_good`.
    """
    columns = df.columns if carry else list(dict.fromkeys([id_col, lang_col, source_col]))
    _refuse(df.select(*(F.col(f"`{c}`") for c in columns)), (*FEATURES, "kept"))
    return judged_rows(df, columns, text_col, lang_col, source_col).select("carried.*", *FEATURES, "kept")


def keep_good(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``df`` that pass, with their columns as they are, whatever their names."""
    return judged_rows(df, df.columns, text_col, lang_col, source_col).filter("kept").select("carried.*")
