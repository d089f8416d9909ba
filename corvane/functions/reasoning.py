"""Whether written reasoning steps are safe, concrete and tied to their answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .taxonomy import any_of
from .text import let

# Markers that make a step unsafe, steps that say nothing, words of concrete and of checking steps.
FORBIDDEN = ("```", "<|", "|>", "system:", "assistant:", "user:", "human:", "question_json", "python_code", "ignore previous", "browse", "search the web", "tool call")
VAGUE = ("analyze the problem", "calculate the answer", "check the answer", "compute", "compute the answer", "find the answer", "solve", "solve the equation", "solve the problem", "substitute", "verify", "verify the answer")
CONCRETE = "add|subtract|multiply|divide|factor|expand|simplif|substitut|equation|inequalit|constraint|derivative|differentiat|integral|integrat|limit|matrix|determinant|vector|probability|combination|permutation|ratio|percent|remainder|modulo|root|logarithm|angle|radius|diameter|area|volume|distance|rate|time|mean|median|variance|therefore|thus|hence"
CHECKING = "check|verify|substitut|recompute|satisf|hold|original|both|independent|confirm"
NOT_SYMBOLS = ("and", "or", "log", "ln", "sqrt", "matrix", "set")


def reasoning_problem(steps: Column, answer: Column, least: int = 2, most: int = 8, shortest: int = 8, longest: int = 400) -> Column:
    """The first reason against a list of steps, null if there is none. A null answer needs no anchor."""
    clean = F.transform(steps, lambda s: F.trim(F.regexp_replace(F.coalesce(s, F.lit("")), r"(?U)\s+", " ")))

    def problem(x: Column) -> Column:
        count = F.size(x)
        low = F.lower(F.array_join(x, " "))
        joined = F.array_join(x, " ")
        vague = lambda s: (F.length(s) < shortest) | F.regexp_replace(F.lower(s), "^[ .:;]+|[ .:;]+$", "").isin(*VAGUE)
        concrete = F.size(F.filter(x, lambda s: s.rlike(rf"(?i)\d|[=<>+\-*/^%()\[\]{{}}]|\b(?:{CONCRETE})\w*")))
        numbers = F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"([+-]?\d+(?:\.\d+)?)"), 1), lambda n: F.ltrim(n, F.lit("+"))))
        # A number stands alone if it is between non-digits: its neighbours are looked at as text, not by a pattern per row.
        padded = F.concat(F.lit(" "), joined, F.lit(" "))
        alone = lambda n: F.exists(F.sequence(F.lit(1), F.size(F.split(padded, F.concat(F.lit("\\Q"), n, F.lit("\\E")))) - 1), lambda i: ~F.get(F.split(padded, F.concat(F.lit("\\Q"), n, F.lit("\\E"))), i - 1).rlike(r"\d$") & ~F.get(F.split(padded, F.concat(F.lit("\\Q"), n, F.lit("\\E"))), i).rlike(r"^\d"))
        found = F.size(F.filter(numbers, lambda n: F.contains(padded, n) & alone(n)))
        symbols = F.filter(F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit("([A-Za-z]+)"), 1), lambda t: F.lower(t))), lambda t: ~t.isin(*NOT_SYMBOLS))
        unanchored = ((F.size(numbers) > 0) & (found < F.least(F.lit(2), F.size(numbers)))) | ((F.size(numbers) == 0) & (F.size(symbols) > 0) & ~F.exists(symbols, lambda t: F.contains(low, t)))
        return (
            F.when((count < least) | (count > most) | F.exists(x, lambda s: s == ""), "invalid_gold_reasoning_steps")
            .when(F.exists(x, lambda s: (F.length(s) > longest) | any_of(F.lower(s), FORBIDDEN)), "unsafe_gold_reasoning_steps")
            .when(F.exists(x, vague) | (concrete < F.least(F.lit(2), count)), "non_concrete_gold_reasoning_steps")
            .when(~joined.rlike(rf"(?i)\b(?:{CHECKING})\w*"), "missing_gold_reasoning_verification")
            .when(answer.isNotNull() & unanchored, "gold_reasoning_not_anchored_to_answer")
        )

    return F.when(steps.isNull(), "missing_gold_reasoning_steps").otherwise(let(clean, problem))
