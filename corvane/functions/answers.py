"""Answer types, normalised values, equivalence, and what kind of error a wrong answer shows.

Everything that needs no computer algebra is a column expression. Symbolic answers are compared as normalised text and,
in ``operators.equivalence``, by evaluation at random rational points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import close, finite_double
from .text import let

# Answer types, their other names, and keywords that stand for them.
TYPES = ("integer", "decimal", "rational", "percentage", "boolean", "text", "symbolic_expression", "equation", "inequality", "set", "interval", "ordered_tuple", "unordered_collection", "vector", "matrix", "unit_value", "multiple_choice")
ALIASES = {
    "int": "integer", "whole_number": "integer", "float": "decimal", "number": "decimal", "numeric": "decimal", "fraction": "rational", "mixed_fraction": "rational", "mixed_number": "rational", "proper_fraction": "rational", "improper_fraction": "rational", "ratio": "rational", "percent": "percentage", "bool": "boolean", "string": "text", "free_text": "text", "expression": "symbolic_expression", "symbolic": "symbolic_expression", "algebraic_expression": "symbolic_expression", "algebraic": "symbolic_expression",
    "polynomial": "symbolic_expression", "function": "symbolic_expression", "ordered_pair": "ordered_tuple", "tuple": "ordered_tuple", "list": "unordered_collection", "collection": "unordered_collection", "array": "vector", "quantity": "unit_value", "quantity_with_unit": "unit_value", "measurement": "unit_value", "choice": "multiple_choice", "multiple_choice_answer": "multiple_choice",
}
KEYWORDS = (("fraction", "rational"), ("ratio", "rational"), ("percent", "percentage"), ("integer", "integer"), ("whole", "integer"), ("decimal", "decimal"), ("float", "decimal"), ("boolean", "boolean"), ("equation", "equation"), ("inequality", "inequality"), ("interval", "interval"), ("matrix", "matrix"), ("vector", "vector"), ("tuple", "ordered_tuple"), ("pair", "ordered_tuple"), ("collection", "unordered_collection"), ("set", "set"), ("unit", "unit_value"), ("measure", "unit_value"), ("choice", "multiple_choice"), ("expression", "symbolic_expression"), ("algebra", "symbolic_expression"), ("polynomial", "symbolic_expression"), ("text", "text"), ("string", "text"))
# Unit names.
UNITS = {"meter": "m", "meters": "m", "metre": "m", "metres": "m", "centimeter": "cm", "centimeters": "cm", "kilometer": "km", "kilometers": "km", "second": "s", "seconds": "s", "minute": "min", "minutes": "min", "hour": "h", "hours": "h", "degree": "deg", "degrees": "deg"}
NUMBER = r"[-+]?(?:\d+(?:\.\d*)?|\.\d+)"


def lookup(names: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), key)


def inferred_type(answer: Column) -> Column:
    """The type that a bare answer looks like."""
    t = F.trim(F.coalesce(answer, F.lit("")))
    rules = (
        (r"^[-+]?\d+\s+\d+\s*/\s*\d+$", "rational"), (r"%$", "percentage"), (rf"^{NUMBER}(?:/\d+)?\s*[A-Za-z°]+$", "unit_value"), ("<=|>=|≤|≥|<|>", "inequality"), ("=", "equation"), (r"^[\[(].+,.+[\])]$", "interval"), (r"^\{.*\}$", "set"), (r"^\(.*,.*\)$", "ordered_tuple"),
        (r"^[-+]?\d+\s*/\s*\d+$", "rational"), (r"^[-+]?\d+$", "integer"), (r"^[-+]?(?:\d+\.\d*|\.\d+)$", "decimal"), (r"(?i)^(?:true|false|yes|no|是|否)$", "boolean"), (r"\\(?:d?frac|tfrac|sqrt|pi|log|ln|sin|cos|tan|cot|sec|csc|cdot|times|pm|infty)\b", "symbolic_expression"), (r"(?s)^(?=.*[A-Za-z])(?=.*[+\-*/^()])", "symbolic_expression"),
    )
    out = None
    for pattern, kind in rules:
        out = F.when(t.rlike(pattern), kind) if out is None else out.when(t.rlike(pattern), kind)
    return out.otherwise("text")


def answer_type(name: Column, answer: Column | None = None) -> Column:
    """One of TYPES from any name: itself, an alias, a keyword, or what the answer looks like."""
    n = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("text")))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    n = F.coalesce(lookup(ALIASES, n), n)
    by_word = None
    for word, kind in KEYWORDS:
        case = F.contains(n, F.lit(word))
        by_word = F.when(case, kind) if by_word is None else by_word.when(case, kind)
    return F.when(n.isin(*TYPES), n).otherwise(F.coalesce(by_word, inferred_type(answer if answer is not None else F.lit(""))))


def clean(answer: Column) -> Column:
    """Trimmed text without an answer label, closing marks or doubled spaces."""
    t = F.trim(F.regexp_replace(F.trim(F.coalesce(answer, F.lit(""))), "^`+|`+$", ""))
    t = F.regexp_replace(t, r"(?i)^(?:answer|final answer)\s*[:=]\s*", "")
    return F.regexp_replace(F.regexp_replace(t, r"(?U)\s+", " "), r"^[ .;]+|[ .;]+$", "")


def candidate(answer: Column) -> Column:
    """Without a leading x =, y = or z = and a closing degree sign."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(answer, F.lit(""))), r"(?i)^[xyz]\s*=\s*", ""), r"\s*°\s*$", ""))


def number(answer: Column, percentage: bool = False) -> Column:
    """A finite double of a decimal, fraction or percentage, commas ignored; null otherwise."""

    def read(t: Column) -> Column:
        percent = t.endswith("%")
        bare = F.trim(F.when(percent, F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t))
        return let(F.struct(bare.alias("t"), percent.alias("percent")), parts)

    def parts(s: Column) -> Column:
        t = s["t"]
        whole = F.when(t.rlike(rf"^{NUMBER}(?:[eE][-+]?\d+)?$"), t.try_cast("double"))
        top, bottom = F.regexp_extract(t, r"^([-+]?\d+)/(\d+)$", 1).try_cast("double"), F.regexp_extract(t, r"^([-+]?\d+)/(\d+)$", 2).try_cast("double")
        return let(F.struct(F.coalesce(whole, F.try_divide(top, bottom)).alias("x"), s["percent"].alias("percent")), scaled)

    def scaled(s: Column) -> Column:
        x = F.when(F.abs(s["x"]) < float("inf"), s["x"])
        return F.when(s["percent"], x / 100).when(F.lit(percentage) & (F.abs(x) > 1), x / 100).otherwise(x)

    return let(F.replace(clean(answer), F.lit(","), F.lit("")), read)


def items(answer: Column) -> Column:
    """The items of a bracketed or bare list, split at commas and semicolons."""
    t = F.translate(clean(answer), ";", ",")
    t = F.when(t.rlike(r"^(?:\(.*\)|\[.*\]|\{.*\})$"), F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)
    return F.filter(F.transform(F.split(t, ","), lambda x: F.trim(x)), lambda x: x != "")


def item_key(item: Column) -> Column:
    """Equal for equal numbers of twelve digits, else the clean text."""
    x = number(item)
    return F.coalesce(F.format_string("%.11e", F.when(x == 0, F.lit(0.0)).otherwise(x)), clean(item))


def unit_value(answer: Column) -> Column:
    """struct<value, unit> of a number with a unit; null otherwise."""
    pattern = rf"^\s*({NUMBER}(?:/\d+)?)\s*([A-Za-z°]+)\s*$"
    t = clean(answer)
    unit = F.lower(F.regexp_extract(t, pattern, 2))
    return F.when(t.rlike(pattern), F.struct(number(F.regexp_extract(t, pattern, 1)).alias("value"), F.coalesce(lookup(UNITS, unit), unit).alias("unit")))


def boolean(answer: Column) -> Column:
    t = F.lower(clean(answer))
    return F.when(t.isin("yes", "true", "1", "是"), True).when(t.isin("no", "false", "0", "否"), False)


def interval(answer: Column) -> Column:
    """struct<low, high, closed_left, closed_right>; null if it isn't one."""
    t = clean(answer)
    pattern = r"^([\[(])\s*([^,]+?)\s*,\s*([^,]+?)\s*([\])])$"
    part = lambda k: F.regexp_extract(t, pattern, k)
    return F.when(t.rlike(pattern), F.struct(part(2).alias("low"), part(3).alias("high"), (part(1) == "[").alias("closed_left"), (part(4) == "]").alias("closed_right")))


def matrix(answer: Column) -> Column:
    """array<array<double>> of rows in brackets or split at semicolons; null if ragged, empty or not of numbers."""
    t = clean(answer)
    nested = F.regexp_extract_all(t, F.lit(r"\[([^\[\]]+)\]"), 1)
    rows = F.when(t.rlike(r"^\[\s*\["), nested).otherwise(F.filter(F.split(F.regexp_replace(t, r"^\[+|\]+$", ""), ";"), lambda r: F.trim(r) != ""))
    made = F.transform(rows, lambda r: F.transform(F.split(r, ","), lambda x: number(F.trim(x))))
    sound = (F.size(made) > 0) & (F.size(F.array_distinct(F.transform(made, lambda r: F.size(r)))) == 1) & F.forall(made, lambda r: F.forall(r, lambda x: x.isNotNull()))
    return F.when(sound, made)


def equivalent(gold: Column, predicted: Column, kind: Column, absolute: float = 1e-6) -> Column:
    """struct<equivalent, status>: status is equal, different, or ambiguous where either side can't be read as its type;
    an ambiguous pair is not equivalent. Equations, inequalities and expressions are equal only as normalised text here."""
    of = lambda kinds, value: F.when(kind.isin(*kinds), value)

    def read(x: Column) -> Column:
        """What ``x`` is as its type; only the reading that the type needs is worked out."""
        return F.struct(
            of(("integer", "rational", "decimal"), number(candidate(x))).alias("number"),
            of(("percentage",), number(candidate(x), True)).alias("percent"),
            of(("boolean",), boolean(x)).alias("boolean"),
            of(("set", "unordered_collection", "ordered_tuple", "vector"), F.transform(items(x), item_key)).alias("items"),
            of(("matrix",), matrix(x)).alias("matrix"),
            of(("unit_value",), unit_value(x)).alias("unit"),
            of(("interval",), interval(x)).alias("interval"),
            F.lower(clean(x)).alias("text"),
        )

    def verdict(left: Column, right: Column, equal: Column) -> Column:
        return F.when(left.isNull() | right.isNull(), "ambiguous").when(equal, "equal").otherwise("different")

    def status_of(s: Column) -> Column:
        g, p = s["g"], s["p"]
        gm, pm, gi, pi = g["matrix"], p["matrix"], g["interval"], p["interval"]
        shape = (F.size(gm) == F.size(pm)) & (F.size(F.flatten(gm)) == F.size(F.flatten(pm)))
        matrix_equal = shape & F.forall(F.zip_with(F.flatten(gm), F.flatten(pm), lambda x, y: F.coalesce(close(x, y, absolute=absolute), F.lit(False))), lambda same: same)
        interval_equal = (item_key(gi["low"]) == item_key(pi["low"])) & (item_key(gi["high"]) == item_key(pi["high"])) & (gi["closed_left"] == pi["closed_left"]) & (gi["closed_right"] == pi["closed_right"])
        return (
            F.when(kind.isin("integer", "rational"), verdict(g["number"], p["number"], F.abs(g["number"] - p["number"]) <= 1e-12 * F.greatest(F.lit(1.0), F.abs(g["number"]))))
            .when(kind == "decimal", verdict(g["number"], p["number"], close(g["number"], p["number"], absolute=absolute)))
            .when(kind == "percentage", verdict(g["percent"], p["percent"], close(g["percent"], p["percent"], absolute=absolute)))
            .when(kind == "boolean", verdict(g["boolean"], p["boolean"], g["boolean"] == p["boolean"]))
            .when(kind.isin("set", "unordered_collection"), verdict(gold, predicted, F.array_sort(g["items"]) == F.array_sort(p["items"])))
            .when(kind.isin("ordered_tuple", "vector"), verdict(gold, predicted, g["items"] == p["items"]))
            .when(kind == "matrix", verdict(gm, pm, matrix_equal))
            .when(kind == "unit_value", verdict(g["unit"]["value"], p["unit"]["value"], (g["unit"]["unit"] == p["unit"]["unit"]) & close(g["unit"]["value"], p["unit"]["value"], absolute=absolute)))
            .when(kind == "interval", verdict(gi, pi, interval_equal))
            .when(kind.isin("text", "multiple_choice"), verdict(gold, predicted, g["text"] == p["text"]))
            .otherwise(F.when(g["text"] == p["text"], "equal").otherwise("ambiguous"))
        )

    status = let(F.struct(read(gold).alias("g"), read(predicted).alias("p")), status_of)
    return let(status, lambda s: F.struct((s == "equal").alias("equivalent"), s.alias("status")))


def fused_verdict(typed: Column, judged: Column, judge_valid: Column, judge_required: Column, format_valid: Column, confidence: Column, least: float = 0.80) -> Column:
    """struct<is_correct, decision>. ``typed`` is the status of ``equivalent``; a judge that is needed but invalid fails the
    item, one that disagrees with a typed equality makes a conflict, and one can accept an ambiguous pair only if the format
    is valid and it is confident."""
    decision = (
        F.when(judge_required & ~judge_valid, "judge_failed")
        .when((typed == "equal") & judge_valid & ~judged, "conflict")
        .when(typed == "equal", "typed_correct")
        .when(typed == "different", "typed_incorrect")
        .when(judge_valid & judged & format_valid & (confidence >= least), "judge_accepted")
        .otherwise("ambiguous")
    )
    return F.struct(decision.isin("typed_correct", "judge_accepted").alias("is_correct"), decision.alias("decision"))


def error_signature(gold: Column, predicted: Column) -> Column:
    """The first numeric error pattern that a wrong number shows: sign, reciprocal, scale, off by one, rounding, other."""
    near = lambda a, b: F.coalesce(close(a, b, 1e-9, 1e-9), F.lit(False))
    return (
        F.when(predicted.isNull() | gold.isNull(), "parse_failed")
        .when(near(gold, predicted), "none")
        .when(near(gold, -predicted), "sign_error")
        .when((gold != 0) & near(predicted * gold, F.lit(1.0)), "reciprocal_error")
        .when(near(gold * 100, predicted) | near(gold, predicted * 100), "scale_or_percentage_error")
        .when(near(F.abs(gold - predicted), F.lit(1.0)), "off_by_one_error")
        .when(F.abs(gold - predicted) <= 0.01 * F.greatest(F.abs(gold), F.lit(1e-12)), "rounding_error")
        .otherwise("arithmetic_computation_error")
    )


def parsed_response(text: Column) -> Column:
    """struct<status, final_answer, confidence, steps>: a whole JSON object, the first one in the text, a line "final
    answer: ...", or nothing."""
    schema = "final_answer string, answer_type string, confidence string, reasoning_summary array<string>"
    direct, inner = F.from_json(text, schema), F.from_json(F.regexp_extract(text, r"(?s)(\{[^{}]*\})", 1), schema)
    line = F.trim(F.regexp_extract(text, r"(?im)^\s*(?:final answer|answer)\s*[:=]\s*(.+)$", 1))
    status = F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "empty").when(direct["final_answer"].isNotNull() & F.trim(text).startswith("{"), "json").when(inner["final_answer"].isNotNull(), "embedded_json").when(line != "", "line").otherwise("failed")
    chosen = F.when(status == "json", direct).when(status == "embedded_json", inner)
    answer = F.coalesce(chosen["final_answer"], F.when(status == "line", line))
    return F.struct(status.alias("status"), answer.alias("final_answer"), finite_double(chosen["confidence"]).alias("confidence"), F.coalesce(chosen["reasoning_summary"], F.array().cast("array<string>")).alias("steps"))
