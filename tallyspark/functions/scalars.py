"""Scalar expressions over model output; Column in, Column out, no Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the answer format of the problem sets, "#### number".
ANSWER = r"####\s*(-?[0-9][0-9,]*(?:\.[0-9]+)?)"
NUMBER = "decimal(38,10)"


def extract_answer(text: Column) -> Column:
    """The last number in ``#### number`` form, or null."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(ANSWER), F.lit(1)), F.lit(-1))


def normalize_number(s: Column) -> Column:
    """Exact number without thousands separators; null if it is none."""
    return F.regexp_replace(s, ",", "").try_cast(NUMBER)


def is_correct(predicted: Column, truth: Column) -> Column:
    """Exact numeric match; a missing answer counts as wrong."""
    return F.coalesce(predicted == truth, F.lit(False))


#: Fixed value: the answer format of the harder problem set, with braces three deep.
BOXED = r"\\boxed\{((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}"


def extract_boxed(text: Column) -> Column:
    r"""The last \boxed{...}, else the last number in ``#### number`` form, or null."""
    boxed = F.try_element_at(F.regexp_extract_all(text, F.lit(BOXED), F.lit(1)), F.lit(-1))
    return F.coalesce(boxed, extract_answer(text))


def normalize_answer(s: Column) -> Column:
    """An answer's text without white space, dollar signs, sizing and spacing commands, text
    wrappers and a final stop; display fractions as plain ones.  Letters keep their case."""
    plain = F.regexp_replace(s, r"\\(?:left|right|displaystyle|[,;:! ])|\$|\s+", "")
    plain = F.regexp_replace(plain, r"\\[dt]frac", r"\\frac")
    plain = F.regexp_replace(plain, r"\\(?:text|mathrm|mbox)\{([^{}]*)\}", "$1")
    return F.regexp_replace(plain, r"\.$", "")


def typed_answer(s: Column) -> Column:
    """struct(number, text): the exact number if the answer is one, else its normalised text;
    null where there is no answer."""
    plain = normalize_answer(s)
    number = normalize_number(F.when(plain.rlike(r"^-?[0-9][0-9,]*(?:\.[0-9]+)?$"), plain))
    return F.when(F.length(plain) > 0, F.struct(number.alias("number"), F.when(number.isNull(), plain).alias("text")))


def answers_match(predicted: Column, truth: Column) -> Column:
    """Equality of typed answers: numbers exactly, other answers by their normalised text,
    without symbolic equality; answers of two kinds, or a missing one, do not match."""
    same = lambda field: predicted[field] == truth[field]
    return F.coalesce(same("number"), same("text"), F.lit(False))


def reward(correct: Column) -> Column:
    return correct.cast("int")


def is_truncated(n_tokens: Column, predicted: Column, cap: int = 500) -> Column:
    """At the generation cap and without an answer."""
    return (n_tokens >= cap) & predicted.isNull()


def normalize_text(s: Column) -> Column:
    """Lower case, single spaces, no punctuation but signs and decimal points."""
    kept = F.regexp_replace(F.lower(s), r"[!\"#$%&'()*,/:;<=>?@\[\\\]^_`{|}~]", "")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def transcription_match(a: Column, b: Column) -> tuple[Column, Column]:
    """(exact, normalised) equality; null texts never match."""
    return F.coalesce(a == b, F.lit(False)), F.coalesce(normalize_text(a) == normalize_text(b), F.lit(False))


def pass_at_k(n: Column, c: Column, k: Column | int) -> Column:
    """Unbiased 1 - C(n-c, k) / C(n, k) in product form; null where n < k."""
    k = F.lit(k) if isinstance(k, int) else k
    product = F.aggregate(F.sequence(F.lit(0), k.cast("int") - 1), F.lit(1.0), lambda a, i: a * (n - c - i) / (n - i))
    return F.when(n < k, F.lit(None).cast("double")).when(n - c < k, F.lit(1.0)).otherwise(1.0 - product)


def survival_ratio(delta_pixel: Column, delta_text: Column) -> Column:
    """Share of the text gain that survives in image mode; null without a text gain."""
    return F.try_divide(delta_pixel, delta_text)


def outcome(text: tuple[Column, Column], pixel: tuple[Column, Column], difference: tuple[Column, Column]) -> Column:
    """Label of a result from (low, high) bounds of the text gain, the pixel gain and
    their difference, in this order of precedence."""
    return (
        F.when(~(text[0] > 0), "no_reference_gain")
        .when(pixel[1] < 0, "D")
        .when((pixel[0] > 0) & (difference[0] > 0), "C")
        .when((pixel[0] > 0) & (difference[1] < 0), "exceeds")
        .when(pixel[0] > 0, "B")
        .when(difference[0] > 0, "A")
        .otherwise("noise")
    )


def calibration_ok(p: Column, low: float = 0.01, high: float = 0.99) -> Column:
    return p.between(low, high)


def cost(hours: tuple[Column, Column], price: tuple[Column, Column]) -> tuple[Column, Column]:
    """(lowest, highest) cost of a range of hours at a range of hourly prices."""
    return hours[0] * price[0], hours[1] * price[1]
