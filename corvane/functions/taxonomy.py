"""The taxonomy dimension and the keyword rules that map text to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Nine categories of three groups each.
TAXONOMY = {
    "Arithmetic": ("Integer Operations", "Fraction and Decimal Operations", "Ratio and Percentage"),
    "Algebra": ("Linear Equations", "Systems of Equations", "Polynomials and Inequalities"),
    "Geometry & Trigonometry": ("Plane Geometry", "Solid Geometry", "Trigonometric Reasoning"),
    "Probability & Statistics": ("Basic Probability", "Combinatorics", "Descriptive Statistics"),
    "Word Problems": ("Rate and Distance", "Work and Mixture", "Financial Applications"),
    "Number Theory": ("Divisibility and Factors", "Prime Factorization", "Modular Arithmetic"),
    "Calculus": ("Limits and Continuity", "Differentiation", "Integration"),
    "Linear Algebra": ("Matrix Operations", "Linear Systems", "Vectors and Vector Spaces"),
    "Composite Comprehensive": ("Cross-Domain Multi-Step Problems", "Proof and Mathematical Reasoning", "Constraint Synthesis"),
}

# Keywords of the categories, the first that matches wins.
CATEGORY_WORDS = (
    ("Composite Comprehensive", ("composite", "cross-domain", "comprehensive")),
    ("Linear Algebra", ("linear algebra", "matrix", "vector space", "eigen")),
    ("Calculus", ("calculus", "derivative", "integral", "limit", "continuity")),
    ("Number Theory", ("number theory", "prime", "divisib", "modular", "congruence")),
    ("Probability & Statistics", ("probability", "statistics", "random", "variance", "mean")),
    ("Geometry & Trigonometry", ("geometry", "trigonometry", "triangle", "circle", "volume")),
    ("Word Problems", ("word problem", "rate", "mixture", "distance", "interest", "work")),
    ("Algebra", ("algebra", "equation", "polynomial", "inequality", "variable")),
    ("Arithmetic", ("arithmetic", "fraction", "decimal", "addition", "subtraction")),
)

# Keywords of the groups, the first that matches wins.
GROUP_WORDS = (
    ("Solid Geometry", ("volume", "surface area", "sphere", "cylinder", "cone")),
    ("Trigonometric Reasoning", ("sine", "cosine", "tangent", "trigon")),
    ("Basic Probability", ("probability", "random", "dice", "coin")),
    ("Combinatorics", ("combination", "permutation", "arrangement")),
    ("Matrix Operations", ("matrix", "determinant")),
    ("Linear Systems", ("linear system", "simultaneous equation")),
    ("Differentiation", ("derivative", "differentiat")),
    ("Integration", ("integral", "integrat")),
    ("Limits and Continuity", ("limit", "continuity")),
    ("Modular Arithmetic", ("modular", "congruence", "remainder")),
    ("Prime Factorization", ("prime factor", "prime number")),
    ("Rate and Distance", ("speed", "distance", "travel", "rate")),
    ("Work and Mixture", ("mixture", "work together", "combined work")),
    ("Financial Applications", ("interest", "profit", "discount", "investment")),
    ("Linear Equations", ("linear equation", "solve for")),
    ("Fraction and Decimal Operations", ("fraction", "decimal")),
    ("Ratio and Percentage", ("ratio", "percent", "percentage")),
)

# Rules for imported questions (category, group, rule, keywords), the first that matches wins.
IMPORT_RULES = (
    ("Linear Algebra", "Matrix Operations", "matrix_keyword", ("matrix", "determinant", "eigenvalue")),
    ("Linear Algebra", "Vectors and Vector Spaces", "vector_keyword", ("vector", "dot product", "cross product")),
    ("Calculus", "Integration", "integration_keyword", ("integral", "integrate", "antiderivative")),
    ("Calculus", "Differentiation", "differentiation_keyword", ("derivative", "differentiate", "d/dx")),
    ("Calculus", "Limits and Continuity", "limit_keyword", ("limit", "continuous")),
    ("Number Theory", "Modular Arithmetic", "modular_keyword", ("modulo", "remainder", " mod ")),
    ("Number Theory", "Prime Factorization", "prime_keyword", ("prime factor", "product of primes")),
    ("Number Theory", "Divisibility and Factors", "divisibility_keyword", ("divisor", "divisible", "gcd", "lcm", "factor")),
    ("Geometry & Trigonometry", "Trigonometric Reasoning", "trig_keyword", ("sin", "cos", "tan", "trigonometric")),
    ("Geometry & Trigonometry", "Solid Geometry", "solid_keyword", ("sphere", "cube", "prism", "cylinder", "volume")),
    ("Geometry & Trigonometry", "Plane Geometry", "plane_keyword", ("triangle", "circle", "angle", "perimeter", "area")),
    ("Probability & Statistics", "Descriptive Statistics", "statistics_keyword", ("mean", "median", "standard deviation", "variance")),
    ("Probability & Statistics", "Combinatorics", "combinatorics_keyword", ("arrange", "committee", "permutation", "combination")),
    ("Probability & Statistics", "Basic Probability", "probability_keyword", ("probability", "random", "drawn", "dice", "coin")),
    ("Word Problems", "Financial Applications", "finance_keyword", ("interest", "profit", "discount", "price", "cost")),
    ("Word Problems", "Work and Mixture", "work_mixture_keyword", ("work together", "mixture", "solution", "machine")),
    ("Word Problems", "Rate and Distance", "rate_keyword", ("speed", "distance", "miles", "km/h", "travel")),
    ("Algebra", "Systems of Equations", "system_keyword", ("system of", "simultaneous", "and solve for")),
    ("Algebra", "Polynomials and Inequalities", "polynomial_keyword", ("polynomial", "inequality", "roots", "quadratic")),
    ("Algebra", "Linear Equations", "equation_keyword", ("solve for", "equation", "unknown")),
    ("Arithmetic", "Ratio and Percentage", "ratio_keyword", ("percent", "%", "ratio", "proportion")),
    ("Arithmetic", "Fraction and Decimal Operations", "fraction_keyword", ("fraction", "decimal", "/")),
)


def any_of(text: Column, keywords: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for k in keywords:
        found = found | F.contains(text, F.lit(k))
    return found


def first_rule(text: Column, rules, default: Column, value) -> Column:
    out = None
    for rule in rules:
        case = any_of(text, rule[-1])
        out = F.when(case, value(rule)) if out is None else out.when(case, value(rule))
    return out.otherwise(default)


def category_of(category: Column, sub_category: Column, question: Column) -> Column:
    text = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (category, sub_category, question)]))
    return first_rule(text, CATEGORY_WORDS, F.lit("Arithmetic"), lambda r: F.lit(r[0]))


def group_of(sub_category: Column, category: Column, question: Column) -> Column:
    """A group of the category by name, another non-empty name as it is, else by keywords, else the category's first."""
    names = {x.lower(): x for xs in TAXONOMY.values() for x in xs}
    value = F.trim(F.regexp_replace(F.coalesce(sub_category, F.lit("")), r"(?U)\s+", " "))
    own = F.try_element_at(F.create_map(*[F.lit(x) for c, xs in TAXONOMY.items() for g in xs for x in (f"{c}|{g.lower()}", g)]), F.concat(category, F.lit("|"), F.lower(value)))
    first = F.try_element_at(F.create_map(*[F.lit(x) for c, xs in TAXONOMY.items() for x in (c, xs[0])]), category)
    other = F.lower(value).isin(list(names))
    rest = F.when(other, F.lit("")).otherwise(value)
    text = F.lower(F.concat_ws(" ", rest, F.coalesce(question, F.lit(""))))
    return F.coalesce(own, F.when((rest != "") & ~rest.rlike("[\\u3400-\\u9fff]"), rest), first_rule(text, GROUP_WORDS, first, lambda r: F.lit(r[0])))


def classify_import(question: Column, source: Column, source_type: Column) -> Column:
    """struct<category, sub_category, rule> of an imported question."""
    text = F.lower(F.coalesce(question, F.lit("")))
    made = lambda c, g, r: F.struct(F.lit(c).alias("category"), F.lit(g).alias("sub_category"), F.lit(r).alias("rule"))
    kind = F.replace(F.lower(F.coalesce(source, F.lit(""))), F.lit(" "), F.lit("_"))
    by_source = F.when((source_type == "hendrycks_math_json") & F.contains(kind, F.lit("number_theory")), made("Number Theory", "Divisibility and Factors", "math_type_number_theory"))
    by_source = by_source.when((source_type == "hendrycks_math_json") & any_of(kind, ("geometry", "precalculus")), made("Geometry & Trigonometry", "Plane Geometry", "math_type_geometry"))
    by_source = by_source.when((source_type == "hendrycks_math_json") & any_of(kind, ("counting", "probability")), made("Probability & Statistics", "Combinatorics", "math_type_counting"))
    by_source = by_source.when(source_type == "hendrycks_math_json", made("Algebra", "Polynomials and Inequalities", "math_type_algebra"))
    by_source = by_source.when(source_type == "gsm8k_jsonl", made("Composite Comprehensive", "Cross-Domain Multi-Step Problems", "gsm8k_fallback"))
    by_source = by_source.when(source_type == "mmlu_csv", made("Composite Comprehensive", "Proof and Mathematical Reasoning", "mmlu_fallback"))
    return first_rule(text, IMPORT_RULES, by_source.otherwise(made("Arithmetic", "Integer Operations", "arithmetic_fallback")), lambda r: made(*r[:3]))


def error_tags(category: Column, text: Column, question: Column) -> Column:
    """Keyword tags of an error, in the order of the tag list."""
    low = F.lower(F.coalesce(text, F.lit("")))
    logic = category.isin("Word Problems", "Composite Comprehensive") | (F.size(F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit(r"([\p{L}\p{N}_]+)"), 1)) >= 35)
    formula = category.isin("Geometry & Trigonometry", "Calculus", "Linear Algebra") | any_of(low, ("formula", "identity", "theorem"))
    calculation = (category == "Arithmetic") | any_of(low, ("calculation", "arithmetic", "computed", "numeric"))
    missing = any_of(low, ("condition", "constraint", "domain", "unit", "assumption", "missing"))
    concept = ~(logic | formula | calculation | missing) | any_of(low, ("concept", "confus", "misunderstood", "incorrect method"))
    tags = F.array(*[F.when(c, F.lit(t)) for c, t in ((concept, "concept_confusion"), (formula, "formula_memory_error"), (calculation, "calculation_error"), (logic, "multi_step_logic_error"), (missing, "condition_missing"))])
    return F.filter(tags, lambda t: t.isNotNull())


def taxonomy(spark: SparkSession, quota: int = 20, weight: float = 1.0) -> DataFrame:
    """The 27 groups: category, sub_category, quota, base_weight."""
    rows = [(c, g, quota, weight) for c, groups in TAXONOMY.items() for g in groups]
    return spark.createDataFrame(rows, "category string, sub_category string, quota int, base_weight double")
