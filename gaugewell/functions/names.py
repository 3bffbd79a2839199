"""Rules over column names, as expressions on a metadata table with one row per column."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Names and suffixes that mark an identifier column.
ID_WORDS = ["id", "uuid", "guid", "identifier", "serial", "email", "phone", "mobile", "zipcode", "zip", "roll_no"]
ID_WORDS_PREP = ID_WORDS + ["roll"]
ID_WORDS_QUALITY = ID_WORDS_PREP + ["aadhaar", "pan", "ssn"]

# Words in a column name that point at the outcome.
OUTCOME_WORDS = [
    "target", "label", "outcome", "result", "final_result", "prediction", "predicted", "actual", "ground_truth",
    "grade", "score", "rank", "pass", "fail", "status", "class", "total",
]

# Words and suffixes in a column name that point at a date.
DATE_WORDS = ["date", "time", "datetime", "timestamp", "created", "updated", "modified", "month", "year"]
DATE_SUFFIXES = ["_date", "_time", "_at"]


def normalise(name: Column) -> Column:
    """Lower case, trimmed, with dashes, spaces and dots as underscores."""
    return F.translate(F.trim(F.lower(name)), "- .", "___")


def tokens(name: Column) -> Column:
    """Distinct non-empty word tokens of a column name."""
    parts = F.split(normalise(name), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.filter(parts, lambda t: t != ""))


def looks_like_id(name: Column, words: list[str]) -> Column:
    """The normalised name is one of the words or ends in an underscore and the word."""
    return normalise(name).rlike(r"(^|_)(" + "|".join(words) + r")$")


def looks_like_date(name: Column) -> Column:
    n = normalise(name)
    hit = F.arrays_overlap(F.split(n, "_"), F.array(*[F.lit(w) for w in DATE_WORDS]))
    return hit | n.rlike("(" + "|".join(DATE_SUFFIXES) + ")$")


def outcome_words(name: Column, words: list[str] = OUTCOME_WORDS) -> Column:
    """Sorted outcome words among the tokens of the name."""
    return F.sort_array(F.array_intersect(tokens(name), F.array(*[F.lit(w) for w in words])))


def shares_token(name: Column, target: Column) -> Column:
    return F.arrays_overlap(tokens(name), tokens(target))


def names_target(name: Column, target: Column) -> Column:
    """The name carries the whole target name as prefix, suffix or token."""
    n, t = normalise(name), normalise(target)
    return (
        F.endswith(n, F.concat(F.lit("_"), t))
        | F.startswith(n, F.concat(t, F.lit("_")))
        | F.array_contains(tokens(name), t)
    )


def metric_key(value: Column, fallback: str = "unknown") -> Column:
    """Stable key: lower case, dash/space/slash as underscore, runs collapsed, ends trimmed."""
    key = F.translate(F.lower(F.trim(value)), "- /", "___")
    key = F.regexp_replace(F.regexp_replace(key, "_+", "_"), "^_|_$", "")
    return F.when(key != "", key).otherwise(F.lit(fallback))
