"""Quality rules with a hashed n-gram log-likelihood ratio, DataFrame only.

The n-grams are runs of one and two word endings (last three code points).
Two multinomials over hashed bins are counted: one over every document of the
raw corpus, one over trusted documents.  A document's score is the sum of the
logarithms of their ratio over its n-grams, divided by their number; sums are
of scaled integers, so the verdict does not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash

BLANKS = r"[\x20\x09-\x0D]+"
#: bins of the multinomials: the table that is broadcast has so many rows
BINS = 1 << 16
#: trusted ids that are broadcast, eight bytes each or so; more are joined by shuffling
BROADCAST_IDS = 1 << 20
#: pseudo-count of a bin in either multinomial
PSEUDO = 5.0
#: least mean log ratio of a document that is kept
THRESHOLD = -0.5
SCALE = 1 << 20
WINDOW = 5
MIN_WORDS = 10
REPEAT_PERCENT = 20


def _words(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def base_columns(docs: DataFrame, text: str) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and
    base_failed of each row; ``text`` is replaced by these.

    Repeated windows of a text are found inside its row: a distinct count
    tells whether there are any, and only then their hashes are sorted."""
    kept = [c for c in docs.columns if c != text]
    lines = F.filter(F.split(F.col(text), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = docs.select(
        *kept,
        F.length(F.regexp_replace(F.col(text), r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        _words(F.col(text)).alias("_w"),
    )
    step = step.select(
        *kept,
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
    )
    window = F.transform(F.sequence(F.lit(0), F.size("_h") - WINDOW), lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(WINDOW)]))
    step = step.withColumn("_win", F.when(F.size("_h") > WINDOW, window)).drop("_h")
    repeated = F.size(F.array_distinct("_win")) < F.size("_win")
    step = step.withColumn("_s", F.when(repeated, F.sort_array(F.transform("_win", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))).drop("_win")
    same = lambda e, other: F.coalesce(e["x"] == other["x"], F.lit(False))
    step = step.withColumn("_f", F.filter("_s", lambda e, i: same(e, F.get("_s", i - 1)) | same(e, F.get("_s", i + 1)))).drop("_s")
    step = step.withColumn("_p", F.sort_array(F.transform("_f", lambda e: e["i"]))).drop("_f")
    covered = F.aggregate(
        F.transform("_p", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_p", i + 1), p + WINDOW) - p)), F.lit(0), lambda a, x: a + x
    )
    step = step.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_p")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT)
    return step.withColumn("base_failed", failed)


def _gram_bins(docs: DataFrame, text: str) -> DataFrame:
    """One row for each n-gram of each row, with its bin."""
    kept = [c for c in docs.columns if c != text]
    ends = docs.select(*kept, F.transform(_words(F.col(text)), lambda w: F.xxhash64(F.substring(w, -3, 3))).alias("_e"))
    pairs = F.zip_with("_e", F.slice(F.col("_e"), 2, F.greatest(F.size("_e"), F.lit(1))), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))
    grams = ends.select(*kept, F.explode(F.concat("_e", pairs)).alias("_g")).where("_g is not null")
    return grams.select(*kept, F.pmod("_g", F.lit(BINS)).cast("int").alias("bin"))


def log_ratios(docs: DataFrame, text: str, flag: str) -> DataFrame:
    """(bin, ratio): scaled log of the trusted against the raw multinomial.
    Every n-gram of every row is counted, with map-side combination."""
    grams = _gram_bins(docs.select(text, flag), text)
    counts = stash(grams.groupBy("bin").agg(F.count(F.lit(1)).alias("raw"), F.sum(F.col(flag).cast("long")).alias("trusted")))
    totals = counts.agg(F.sum("raw").alias("all_raw"), F.sum("trusted").alias("all_trusted")).first()
    share = (totals["all_trusted"] or 0) / (totals["all_raw"] or 1)
    ratio = F.log((F.col("trusted") + PSEUDO) / (F.col("raw") * F.lit(share) + PSEUDO))
    return counts.select("bin", F.round(ratio * SCALE).cast("long").alias("ratio"))


def quality_rules(df: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Base counts and the ratio's verdict for every row: id, n_words,
    word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score
    (mean log ratio, 0 without words) and kept.

    ``trusted`` has the ids of trusted documents in ``id_col``.  A null text
    has no words and fails, an empty one too; null ids are never trusted;
    repeated rows are judged alike and all returned; without trusted documents
    all ratios are 0; a very long text is one row with an array of its words;
    there are no ties; an empty table gives no rows.  Other columns of ``df``
    are not read, whatever their names.  Counts are made when this is called."""
    ids = trusted.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_t")).distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    source = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    keyed = source.withColumns({"_ka": F.xxhash64("_id", "_text"), "_kb": F.xxhash64(F.lit(17), F.length("_text"), "_text", "_id")})
    flagged = source.join(ids, F.col("_id") == F.col("_t"), "left").withColumn("_trusted", F.col("_t").isNotNull())
    ratios = log_ratios(flagged, "_text", "_trusted")
    grams = _gram_bins(keyed.select("_ka", "_kb", "_text"), "_text").join(F.broadcast(ratios), "bin")
    scores = grams.groupBy("_ka", "_kb").agg((F.sum("ratio") / F.count(F.lit(1)) / SCALE).alias("_score"))
    base = base_columns(keyed, "_text")
    judged = base.join(scores, ["_ka", "_kb"], "left").withColumn("score", F.coalesce("_score", F.lit(0.0)))
    return judged.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score",
        (~F.col("base_failed") & (F.col("score") >= threshold)).alias("kept"),
    )
