"""Text normalisation, signatures, shingles and similarities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
# Units that a template replaces.
UNITS = ("km", "cm", "mm", "m", "kg", "g", "hours?", "minutes?", "seconds?", "degrees?")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, also where lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def squeezed(c: Column) -> Column:
    """Lower case, trimmed, each run of white space one space."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")


def normalized(c: Column) -> Column:
    """Squeezed text without signs other than those of formulas; null is empty."""
    return F.regexp_replace(squeezed(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_\s%+\-*/=().<>{}\[\],]", "")


def template(c: Column) -> Column:
    """Normalised text with numbers, units and single letters replaced, in this order."""
    edge, end = f"(?<!{WORD})", f"(?!{WORD})"
    x = F.regexp_replace(normalized(c), rf"{edge}\d+(?:\.\d+)?(?:/\d+)?{end}", "<NUM>")
    x = F.regexp_replace(x, f"{edge}(?:{'|'.join(UNITS)}){end}", "<UNIT>")
    return F.regexp_replace(x, f"{edge}[a-z]{end}", "<VAR>")


def joined_hash(*parts: Column) -> Column:
    """SHA-256 of the parts, null as empty, joined by bars."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def exact_signature(question: Column, answer: Column, category: Column, sub_category: Column) -> Column:
    return joined_hash(normalized(question), normalized(answer), F.coalesce(category, F.lit("")), F.coalesce(sub_category, F.lit("")))


def unique_key(category: Column, sub_category: Column, question: Column) -> Column:
    return joined_hash(squeezed(category), squeezed(sub_category), squeezed(question))


def words(c: Column) -> Column:
    """Words of normalised text."""
    return F.array_remove(F.split(normalized(c), " "), "")


def shingles(tokens: Column, n: int) -> Column:
    """Distinct ``n``-grams; of fewer tokens than n, all of them as one; none of none."""
    return let(tokens, lambda t: _grams(t, n, " "))


def _grams(t: Column, n: int, joiner: str) -> Column:
    many = F.transform(F.sequence(F.lit(0), F.size(t) - n), lambda i: F.concat_ws(joiner, F.slice(t, i + 1, n)))
    return F.array_distinct(F.when(F.size(t) >= n, many).when(F.size(t) > 0, F.array(F.concat_ws(joiner, t))).otherwise(F.array().cast("array<string>")))


def jaccard(a: Column, b: Column) -> Column:
    """Of two distinct arrays; both empty are equal."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def containment(part: Column, whole: Column) -> Column:
    """Share of ``part`` that is in ``whole``; an empty part is not contained."""
    return F.when(F.size(part) == 0, 0.0).otherwise(F.size(F.array_intersect(part, whole)) / F.size(part))


def counts(tokens: Column) -> Column:
    """map<token, count>, by the lengths of equal runs in sorted order."""
    def runs(t: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i) != F.get(t, i - 1)))
        return let(F.struct(t.alias("t"), starts.alias("s")), lambda x: F.map_from_entries(F.transform(x["s"], lambda a, k: F.struct(F.get(x["t"], a), (F.coalesce(F.get(x["s"], k + 1), F.size(x["t"])) - a).cast("double")))))

    empty = F.map_from_entries(F.array().cast("array<struct<k:string,v:double>>"))
    return let(F.array_sort(tokens), lambda t: F.when(F.size(t) > 0, runs(t)).otherwise(empty))


def pair_tfidf(a: Column, b: Column) -> Column:
    """Cosine of the tf-idf vectors of two token lists that are their own corpus: a shared token weighs 1, one of a
    single text ln(3 / 2) + 1. Both empty are equal, one empty shares nothing."""
    alone = 1 + F.log(F.lit(1.5))

    def score(m: Column) -> Column:
        ca, cb = m["a"], m["b"]
        weight = lambda own, other: F.aggregate(F.map_entries(own), F.lit(0.0), lambda s, e: s + F.pow(e["value"] * F.when(F.map_contains_key(other, e["key"]), 1.0).otherwise(alone), F.lit(2.0)))
        dot = F.aggregate(F.map_entries(ca), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at(cb, e["key"]), F.lit(0.0)))
        return dot / F.sqrt(weight(ca, cb) * weight(cb, ca))

    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(let(F.struct(counts(a).alias("a"), counts(b).alias("b")), score))


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of numbers, clipped to [-1, 1]; null if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norm)))


def ascii_shingles(c: Column, n: int = 2) -> Column:
    """Shingles for MinHash: words of ASCII letters, digits and underscores, and single other signs."""
    tokens = F.regexp_extract_all(F.lower(F.trim(c)), F.lit(r"([a-z0-9_]+|[^\p{L}\p{N}_\s])"), 1)
    return let(tokens, lambda t: _grams(t, n, "␟"))


def minhash(items: Column, permutations: int) -> Column:
    """Signature: an item is hashed once, to the number h of the first seven hex digits of its MD5; permutation p sends it to
    (a h + b) mod 2^31 - 1, with a and b of ``permutation``; each place is the least number over all items."""
    salts = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in map(permutation, range(permutations))])
    hashed = F.transform(items, lambda x: F.conv(F.substring(F.md5(x), 1, 7), 16, 10).cast("long"))
    return let(hashed, lambda own: F.transform(salts, lambda p: F.array_min(F.transform(own, lambda h: (p["a"] * h + p["b"]) % PRIME))))


PRIME = 2**31 - 1


def permutation(p: int) -> tuple[int, int]:
    """The factor and the shift of permutation ``p``."""
    return 1 + (p + 1) * 2_654_435_761 % (PRIME - 1), (p + 1) * 1_597_334_677 % PRIME


def signature_similarity(a: Column, b: Column) -> Column:
    """Share of equal places of two signatures; two empty ones are equal."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))
    return F.when(F.size(a) == 0, 1.0).otherwise(equal / F.size(a))


# The words and signs of a structure signature.
STRUCTURE_FUNCTIONS = "sin|cos|tan|log|ln|sqrt|integrate|differentiate|determinant|probability"
STRUCTURE_RELATIONS = "sum|product|ratio|percent|solve|prove|matrix|derivative|integral"


def structure_signature(c: Column) -> Column:
    """Functions, relation words and operators of a question, in order, joined by bars."""
    text = F.lower(F.coalesce(c, F.lit("")))
    found = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), 1)
    edge, end = f"(?<!{WORD})", f"(?!{WORD})"
    return F.concat_ws("|", F.concat(found(f"{edge}({STRUCTURE_FUNCTIONS}){end}"), found(f"{edge}({STRUCTURE_RELATIONS}){end}"), found(r"(<=|>=|!=|==|[=+\-*/^<>()\[\]{},])")))


def estimated_tokens(c: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up; 0 for null and empty."""
    return F.coalesce(F.ceil(F.octet_length(c) / 4), F.lit(0)).cast("long")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def cut_at(c: Column, stops: list[str]) -> Column:
    """Text before the first of the stop strings."""
    places = F.filter(F.array(*[F.instr(c, s) for s in stops]), lambda p: p > 0)
    return F.when(F.size(places) > 0, F.substring(c, F.lit(1), F.array_min(places) - 1)).otherwise(c)


def has_cjk(c: Column) -> Column:
    return F.coalesce(c.rlike("[\\u3400-\\u9fff]"), F.lit(False))


def prompt_echo(response: Column, prompt: Column, question: Column) -> Column:
    """Whether a response repeats the first 120 characters of its prompt or 100 of the question."""
    squeeze = lambda x: F.regexp_replace(F.lower(F.trim(F.coalesce(x, F.lit("")))), r"(?U)\s+", " ")
    r, p, q = squeeze(response), F.substring(squeeze(prompt), 1, 120), F.substring(squeeze(question), 1, 100)
    return ((F.length(p) > 0) & F.contains(r, p)) | ((F.length(q) >= 40) & F.contains(r, q))


# Patterns of tool calls and of role prefixes.
TOOL_PATTERNS = (r"<tool_call>", r'"tool_calls"\s*:', r'"function"\s*:', r"\bpython\s*\(", r"\bsympy\.", r"\bcalculator\b", r"\bbrowse(?:r)?\b", r"\bsearch_engine\b")
ROLE_PREFIX = r"(?i)^\s*(?:Human|User|System|Assistant)\s*:"


def tool_call(c: Column) -> Column:
    return F.coalesce(c.rlike("(?i)" + "|".join(TOOL_PATTERNS)), F.lit(False))


def role_prefix(c: Column) -> Column:
    return F.coalesce(c.rlike(ROLE_PREFIX), F.lit(False))


def paragraphs(c: Column) -> Column:
    """Lines of more than two words and more than one sentence."""
    lines = F.split(F.coalesce(c, F.lit("")), "\n")
    return F.filter(lines, lambda x: (F.size(F.split(F.trim(x), " ")) > 2) & (F.size(F.split(x, "\\.")) > 2))


def parenthesis_depth(c: Column) -> Column:
    """Greatest nesting of brackets of any kind; a closing one too many counts nothing."""
    start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("m"))
    brackets = F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^()\[\]{}]", ""), "")

    def step(s: Column, ch: Column) -> Column:
        d = F.when(ch.isin("(", "[", "{"), s["d"] + 1).when(ch.isin(")", "]", "}"), F.greatest(F.lit(0), s["d"] - 1)).otherwise(s["d"])
        return F.struct(d.alias("d"), F.greatest(s["m"], d).alias("m"))

    return F.aggregate(brackets, start, step, lambda s: s["m"])
