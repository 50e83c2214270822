"""Quality rules: a threshold table compiled into one Spark projection.

Every measure and every rule is a DataFrame expression; no user function runs.  The
measures of a text are made in one projection (words and lines once), the rules of the
table in the next.

Defined results: null text has no words and fails the base rules; an empty table gives an
empty result; repeated rows are judged one by one; columns besides doc_id and text are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words of the four languages (lower case).
STOP_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which you were her all she there would their we him been has when who will no more if out so what up said its about than into them can only other".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son aux été comme mais on ses cette nous sa fait leur elle deux ont être dit entre dont où".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está".split(),
}

#: Rules of the method: measure, lowest and highest value that passes (None: open), words from which it holds.
THRESHOLDS = (
    ("mean_word_chars", 1.5, 30.0, 0),
    ("symbols_per_word", None, 0.3, 0),
    ("stop_word_ratio", 0.08, None, 50),
    ("dup_line_ratio", None, 0.5, 0),
    ("upper_ratio", None, 0.8, 0),
)

_SPACE = r"[\x20\x09-\x0D]+"


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of the contract and the ratios that rules look at."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    stop = sorted({w for ws in STOP_WORDS.values() for w in ws})
    has_word = lambda line: F.regexp_like(line, F.lit(r"[^\x20\x09-\x0D]"))

    split = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.filter(F.split(text, _SPACE), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n"), has_word).alias("lines"),
        F.length(F.regexp_replace(text, _SPACE, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("double").alias("upper"),
        (F.length(text) - F.length(F.regexp_replace(text, r"\p{L}+", ""))).cast("double").alias("letters"),
    )
    # 3-word windows sorted by hash and then place; equal neighbours are repeats.  The two
    # hashes, of 64 and 32 bits, stand for the window.
    window = lambda i: F.struct(
        F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("h"),
        F.hash(F.get("words", i + 2), F.get("words", i + 1), F.get("words", i)).alias("g"),
        i.alias("i"),
    )
    n = F.size("words")
    windows = F.when(n >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), window)))
    step = split.select("*", n.cast("long").alias("n_words"), windows.alias("windows"))

    def same(w: Column, x: Column, at: Column) -> Column:
        y = F.get(w, at)
        return F.coalesce((y["h"] == x["h"]) & (y["g"] == x["g"]), F.lit(False))

    repeats = F.transform(F.array("windows"), lambda w: F.sort_array(F.transform(F.filter(w, lambda x, j: same(w, x, j - 1) | same(w, x, j + 1)), lambda x: x["i"])))
    step = step.select("*", F.coalesce(F.get(repeats, F.lit(0)), F.array().cast("array<int>")).alias("repeats"))
    covered = F.aggregate(  # each window covers 3 words, less what the one before has covered
        "repeats", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last"))
    )["n"]
    dup = (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")
    trimmed = lambda w: F.rtrim(w, F.lit(".,;:!?"))
    longest = max(map(len, stop))  # lower-casing never makes a word shorter, so no longer one is a stop word
    stops = F.size(F.filter("words", lambda w: (F.length(trimmed(w)) <= longest) & F.lower(trimmed(w)).isin(*stop)))
    per = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    made = F.struct(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        dup.alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        per(F.col("word_chars"), F.col("n_words")).alias("mean_word_chars"),
        per(F.col("n_symbols"), F.col("n_words")).alias("symbols_per_word"),
        per(stops, F.col("n_words")).alias("stop_word_ratio"),
        per(dup, F.size("lines")).alias("dup_line_ratio"),
        per(F.col("upper"), F.col("letters")).alias("upper_ratio"),
    )
    # One element to unpack: a filter or join on the measures stays above, where copies of their expressions would be planned.
    return step.select(F.inline(F.array(made)))


def compiled(thresholds=THRESHOLDS) -> Column:
    """One boolean expression: all rules of the table pass."""
    out = F.lit(True)
    for measure, low, high, from_words in thresholds:
        rule = F.lit(True)
        if low is not None:
            rule &= F.col(measure) >= low
        if high is not None:
            rule &= F.col(measure) <= high
        out &= rule | (F.col("n_words") < from_words)
    return out


def quality_rules(docs: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measures(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), (~base_failed & compiled(thresholds)).alias("kept"))
