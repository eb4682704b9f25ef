"""Training data: filters, pairs, splits, corruption, features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import dice


def preprocess(rows: DataFrame, ratio: Column, ambiguous: Column | None = None, least: int = 10, most: int = 1000, min_ratio: float = 0.6) -> DataFrame:
    """Add ``reason``: null for rows that stay, else the first of empty, short, long, script, ambiguous."""
    n = F.length(F.trim(F.coalesce("text", F.lit(""))))
    reason = F.when(n == 0, "empty").when(n < least, "short").when(n > most, "long").when(ratio < min_ratio, "script")
    if ambiguous is not None:
        reason = reason.when((ambiguous > 0.3) & (ambiguous <= 0.7), "ambiguous")
    return rows.withColumn("reason", reason)


def report(judged: DataFrame) -> DataFrame:
    """Rows by reason; those that stay count as kept."""
    return judged.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("rows"))


def dedup_lines(lines: DataFrame, text: str, order: list[str]) -> DataFrame:
    """The first row of each text by ``order``; null texts go. Aggregates before it shuffles, so a very common line is no hot group."""
    first = lines.filter(F.col(text).isNotNull()).groupBy(F.col(text).alias("_t")).agg(F.min(F.struct(*order)).alias("_f"))
    return first.select(F.col("_t").alias(text), *[F.col(f"_f.{c}").alias(c) for c in order])


def pair_filters(pairs: DataFrame, ratio: Column, order: list[str], min_ratio: float = 0.8, min_length: float = 0.7, max_bytes: int = 512) -> DataFrame:
    """Pairs (corrupted, clean) with enough of the script, more than blanks changed, not too short, within bytes; the first of equal inputs."""
    bare = lambda c: F.regexp_replace(c, r"[ \t\n\r]+", "")
    ok = (ratio >= min_ratio) & (bare("corrupted") != bare("clean")) & (F.length("corrupted") >= min_length * F.length("clean")) & (F.octet_length("corrupted") <= max_bytes) & (F.octet_length("clean") <= max_bytes)
    w = Window.partitionBy("corrupted").orderBy(*order)
    return pairs.filter(ok).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def split(rows: DataFrame, key: Column, train: int = 90, dev: int = 5, pinned: Column | None = None) -> DataFrame:
    """Add ``split`` by hash of the key; pinned rows always train."""
    part = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % 100
    out = F.when(part < train, "train").when(part < train + dev, "dev").otherwise("test")
    return rows.withColumn("split", F.when(pinned, "train").otherwise(out) if pinned is not None else out)


def stratified(rows: DataFrame, stratum: str, key: Column, dev: int = 2) -> DataFrame:
    """Add ``split``: every dev-th row of each stratum, in order of hash, is dev, the rest test. Places are counted in 4,096 ranges of the hash, so that no task sorts a stratum."""
    hashed = rows.withColumn("_h", F.md5(key.cast("string"))).withColumn("_r", F.substring("_h", 1, 3))
    n = hashed.groupBy(F.col(stratum).alias("_s"), F.col("_r").alias("_k")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_s").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = n.select("_s", "_k", before.alias("_before"))
    own = F.row_number().over(Window.partitionBy(stratum, "_r").orderBy("_h"))
    x = hashed.withColumn("_own", own).join(n, F.col(stratum).eqNullSafe(F.col("_s")) & (F.col("_r") == F.col("_k")))
    return x.withColumn("split", F.when((F.col("_before") + F.col("_own")) % dev == 1 % dev, "dev").otherwise("test")).select(*rows.columns, "split")


def sample(rows: DataFrame, key: Column, n: int, seed: int = 0) -> DataFrame:
    """n rows by least hash; the same on every run."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), key).limit(n)


def corrupt(words: Column, kind: str, at: Column) -> Column:
    """One synthetic error in the word at place ``at`` (from 1) of an array: drop a letter, double one, swap two, join with the next word, or split."""
    w = F.element_at(words, at)
    half = F.greatest(F.floor(F.length(w) / 2).cast("int"), F.lit(1))
    head, tail = F.substring(w, F.lit(1), half), F.substring(w, half + 1, F.length(w))
    new = {
        "drop": F.concat(F.substring(w, F.lit(1), half - 1), tail),
        "double": F.concat(head, F.substring(w, half, F.lit(1)), tail),
        "swap": F.concat(F.substring(w, F.lit(1), half - 1), F.substring(w, half + 1, F.lit(1)), F.substring(w, half, F.lit(1)), F.substring(w, half + 2, F.length(w))),
        "split": F.concat(head, F.lit(" "), tail),
        "join": F.concat(w, F.coalesce(F.get(words, at), F.lit(""))),
    }[kind]
    skip = at + 1 if kind == "join" else at
    return F.concat(F.slice(words, F.lit(1), at - 1), F.array(new), F.slice(words, skip + 1, F.size(words)))


def reranker_features(candidates: DataFrame) -> DataFrame:
    """Features of (error_id, error, candidate, frequency, distance, rank): relative log frequency, dice, lengths, inverse rank, first letters."""
    w = Window.partitionBy("error_id")
    logf = F.log1p(F.col("frequency"))
    return candidates.withColumns(
        {
            "log_frequency": logf,
            "relative_frequency": F.when(F.max(logf).over(w) > 0, logf / F.max(logf).over(w)).otherwise(F.lit(0.0)),
            "dice": dice(F.col("error"), F.col("candidate")),
            "length_gap": F.abs(F.length("error") - F.length("candidate")),
            "inverse_rank": 1.0 / F.col("rank"),
            "same_first": F.substring("error", 1, 1) == F.substring("candidate", 1, 1),
            "candidates": F.count("*").over(w),
        }
    )


# Characters of the script that are taken for one another, by kind of synthetic error; an empty one is dropped.
SCRIPT_KINDS = {
    "medial": {"ျ": "ြ", "ြ": "ျ", "ွ": "ှ", "ှ": "ွ"},
    "similar": {"ဝ": "၀", "၀": "ဝ", "ဥ": "ဉ", "ဉ": "ဥ", "ရ": "၇", "ိ": "ီ", "ီ": "ိ", "ု": "ူ", "ူ": "ု"},
    "aspirated": {"က": "ခ", "ခ": "က", "စ": "ဆ", "ဆ": "စ", "တ": "ထ", "ထ": "တ", "ပ": "ဖ", "ဖ": "ပ"},
    "deletion": {"်": "", "့": "", "း": "", "ံ": ""},
    "insertion": {"်": "််", "့": "့့", "း": "းး"},
    "typo": {"ါ": "ာ", "ာ": "ါ", "ဿ": "သ", "။": "၊", "၊": "။"},
}


def swap_first(text: Column, table: dict[str, str]) -> Column:
    """The text with its first character of the table swapped; without any as it is."""
    at = F.length(text) - F.length(F.regexp_replace(text, f"^[^{''.join(table)}]*", "")) + 1
    to = F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.substring(text, at, F.lit(1)))
    return F.when(text.rlike(f"[{''.join(table)}]"), F.concat(F.substring(text, F.lit(1), at - 1), to, F.substring(text, at + 1, F.length(text)))).otherwise(text)


def corrupt_script(text: Column, kind: str) -> Column:
    """One synthetic error of the kind in a text of the script."""
    return swap_first(text, SCRIPT_KINDS[kind])


def chosen_kind(key: Column) -> Column:
    """A kind of error by the hash of the key."""
    at = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % len(SCRIPT_KINDS)
    return F.element_at(F.array(*[F.lit(k) for k in SCRIPT_KINDS]), (at + 1).cast("int"))


def corrupted(text: Column, key: Column) -> Column:
    """The text with an error of the kind that the hash of the key chooses."""
    out = text
    for kind in SCRIPT_KINDS:
        out = F.when(chosen_kind(key) == kind, corrupt_script(text, kind)).otherwise(out)
    return out


def swap_word(words: Column, table: dict[str, str]) -> Column:
    """The words with the first one of the table (homophones, particles) swapped for its counterpart."""
    to = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    at = F.array_min(F.filter(F.array(*[F.array_position(words, F.lit(k)) for k in table]), lambda p: p > 0))
    at = at.cast("int")
    return F.when(at.isNull(), words).otherwise(F.concat(F.slice(words, F.lit(1), at - 1), F.array(F.element_at(to, F.element_at(words, at))), F.slice(words, at + 1, F.size(words))))
