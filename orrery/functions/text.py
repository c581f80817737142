"""Extraction, normalization and checks of texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import symbolic

# Patterns, possessive where a long text would exhaust the stack of the regex engine.
BOXED = r"\\boxed\{((?:[^{}]++|\{[^{}]*+\})*+)\}"
BOXED_FLAT = r"\\boxed\{([^{}]*)\}"
BOXED_GREEDY = r"\\boxed\{(.*)\}"
BOXED_DEEP = r"\\boxed\{((?:[^{}]++|\{(?:[^{}]++|\{[^{}]*+\})*+\})*+)\}"
FINAL_ANSWER = r"Final Answer:((?:[^<\n]|<[^<])*+)\n"
THE_ANSWER = r"The answer is:((?:[^<\n]|<[^<])*+)\n"
CHOICE = r"(?:\$\$\s*)?\\boxed\{[^}]*?([A-Z])[^}]*\}(?:\s*\$\$)?|(?:\*{0,2}\s*)?(?:Final|Correct)\s*Answer:\s*([A-Z])\."
CHAT_USER, CHAT_ASSISTANT, PLAIN_ASSISTANT = "<|im_start|>user", "<|im_start|>assistant", "Assistant:"
STOP_WORDS = ["</s>", "<|im_end|>", "<|endoftext|>"]
BRACKETS = ["{}", "[]", "()"]
ANSWER_PREFIXES = ["The answer is:", "The final answer is ", "The final answer is: ", "The answer is "]
LATEX_WRAPS = ["boxed{", "text{", "texttt{"]
FLOAT_DIGITS, LICENSED_DIGITS, LEAST_FLOAT = 8, 16, 1e-9
SYMBOLIC_HINTS = ["sqrt", "pi", "exp", "log", "ln", "sin", "cos", "tan", "atan", "asin", "acos", "rational", "frac", "/", "i*", "*i", "**", "^"]
ROUNDING_PHRASES = ["round to", "rounded to", "decimal places", "to the nearest"]
NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)$"
LETTERS = "ABCDEFGHIJ"
ANSWER_TOLERANCE = 1e-4
# End of fixed values.


def let(value: Column, f, *more) -> Column:
    """``f(value, *more)`` with the value made once: repeated in a chain of conditions it would be made exponentially often."""
    return F.get(F.transform(F.array(value), lambda x: f(x, *more)), F.lit(0))


def last_match(text: Column, pattern: str) -> Column:
    """Group 1 of the last match, or null."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(-1))


def boxed(text: Column) -> Column:
    return F.trim(last_match(text, BOXED))


def boxed_greedy(text: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, BOXED_GREEDY, 1)), F.lit(""))


def boxed_flat(text: Column) -> Column:
    return last_match(text, BOXED_FLAT)


def boxed_deep(text: Column) -> Column:
    """The last boxed content, two levels of braces in it, as it stands."""
    return last_match(text, BOXED_DEEP)


def final_answer(text: Column) -> Column:
    """After the last "Final Answer:", else after the last "The answer is:", up to the line's end, as it stands."""
    return F.coalesce(last_match(text, FINAL_ANSWER), last_match(text, THE_ANSWER))


def solution(text: Column) -> Column:
    """The answer in a model's turn: chat prefix and what follows a stop word off, then the box, else the final answer."""
    chat = F.when(F.contains(text, F.lit(CHAT_ASSISTANT)), F.concat(F.lit(CHAT_ASSISTANT), _after_first(text, CHAT_ASSISTANT))).otherwise(text)
    out = F.when(F.contains(text, F.lit(CHAT_USER)), chat).when(
        F.contains(text, F.lit(PLAIN_ASSISTANT)), _strip(F.substring_index(text, PLAIN_ASSISTANT, -1))
    ).otherwise(text)
    for word in STOP_WORDS:
        out = let(out, lambda x, w: F.when(F.contains(x, F.lit(w)), _strip(F.substring_index(x, w, 1))).otherwise(x), word)
    return let(out, lambda x: F.coalesce(F.nullif(boxed_deep(x), F.lit("")), final_answer(x)))


def choice_letter(text: Column) -> Column:
    """The letter of the first multiple-choice mark, if that is a box; a written one gives null."""
    return F.nullif(F.regexp_extract(text, CHOICE, 1), F.lit(""))


def _after_first(text: Column, mark: str) -> Column:
    return F.substring(text, F.locate(mark, text) + len(mark), F.length(text))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    """Runs of white space as one blank, trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def template(text: Column) -> Column:
    """Numbers as N, lower case, squeezed."""
    return squeeze(F.lower(F.regexp_replace(text, r"\d+(\.\d+)?", "N")))


def normalize_answer(text: Column, drop_blanks: bool = True) -> Column:
    """Lower case, one matching pair of brackets of each kind off, no final stops, no commas; blanks dropped or squeezed."""
    t = F.lower(_strip(text))
    for opening, closing in BRACKETS:
        t = let(t, lambda x, o, c: F.when(_inside(x, o, c), _strip(F.substring(x, F.lit(2), F.length(x) - 2))).otherwise(x), opening, closing)
    t = F.replace(F.rtrim(t, F.lit(".")), F.lit(","), F.lit(""))
    return F.replace(t, F.lit(" "), F.lit("")) if drop_blanks else squeeze(t)


def _inside(t: Column, opening: str, closing: str) -> Column:
    return (F.length(t) > 1) & F.startswith(t, F.lit(opening)) & F.endswith(t, F.lit(closing))


def clean_number(text: Column) -> Column:
    t = F.regexp_replace(F.translate(text, "$,{}% ", ""), r"\\left|\\right|\\", "")
    return F.trim(t)


def parse_number(text: Column) -> Column:
    """The double of a plain decimal number, else null."""
    t = clean_number(text)
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def decimals(text: Column) -> Column:
    """Digits after the point, trailing zeros too."""
    return F.length(F.regexp_extract(clean_number(text), r"\.(\d+)$", 1))


def rounding_recovered(prediction: Column, reference: Column) -> Column:
    """Whether the prediction rounds to a reference that has decimals: within half a unit of its last place."""
    p, r, d = parse_number(prediction), parse_number(reference), decimals(reference)
    return F.coalesce((d > 0) & (F.abs(p - r) <= F.lit(0.5) * F.pow(F.lit(10.0), -d)), F.lit(False))


def same_number(a: Column, b: Column, tolerance: float = ANSWER_TOLERANCE) -> Column:
    """Numeric equality; simple fractions are evaluated."""

    def value(t: Column) -> Column:
        top, low = F.regexp_extract(t, r"^([+-]?\d+)/(\d+)$", 1), F.regexp_extract(t, r"^([+-]?\d+)/(\d+)$", 2)
        return F.coalesce(parse_number(t), F.try_divide(top.try_cast("double"), low.try_cast("double")))

    return F.coalesce(F.abs(value(a) - value(b)) <= tolerance, F.lit(False))


def answers_equal(a: Column, b: Column) -> Column:
    """Tier 1: normalized text; tier 2: numbers within a tolerance; tier 3: the same expression, set or interval, numbers within the tolerance."""
    plain = F.coalesce(normalize_answer(a) == normalize_answer(b), F.lit(False)) | same_number(a, b)
    return plain | symbolic.same(F.when(~plain, a), b, ANSWER_TOLERANCE)


def unwrap_latex(text: Column) -> Column:
    """Dollar signs around, and the inside of a box or text command that ends the answer."""
    out = let(text, lambda x: F.when(_inside(x, "$", "$"), F.substring(x, F.lit(2), F.length(x) - 2)).otherwise(x))

    def off(x: Column, wrap: str) -> Column:
        body = F.split_part(F.left(x, F.length(x) - 1), F.lit(wrap), F.lit(2))
        return F.when(F.contains(x, F.lit(wrap)) & F.endswith(x, F.lit("}")), body).otherwise(x)

    for wrap in LATEX_WRAPS:
        out = let(out, off, wrap)
    return out


def prediction(sample: Column) -> Column:
    """The answer of a sample: after its prefix, without wraps, first line, lower case, no stars, no final stop."""
    out = _strip(F.coalesce(sample, F.lit("")))
    for prefix in ANSWER_PREFIXES:
        out = let(out, lambda x, p: F.when(F.contains(x, F.lit(p)), _strip(F.substring_index(x, p, -1))).otherwise(x), prefix)
    out = F.lower(unwrap_latex(_without_stop(out)))
    out = F.replace(F.replace(out, F.lit(", "), F.lit(",")), F.lit("**"), F.lit(""))
    return _without_stop(F.substring_index(out, "\n", 1))


def _without_stop(text: Column) -> Column:
    return let(text, lambda x: F.when(F.endswith(x, F.lit(".")), F.left(x, F.length(x) - 1)).otherwise(x))


def fuzzy_equal(a: Column, b: Column) -> Column:
    """A cleaned prediction ``a`` against a reference ``b``.

    Equal, (x) = x for one character and nothing else then, equal numbers, quotes, [x] = x, and a
    final question mark of the prediction do not matter.
    """
    return let(a, lambda x: let(b, lambda y: _fuzzy(x, y)))


def _fuzzy(a: Column, b: Column) -> Column:
    single = lambda t: (F.length(t) == 3) & F.startswith(t, F.lit("(")) & F.endswith(t, F.lit(")"))
    quoted = lambda t: F.replace(t, F.lit("'"), F.lit(""))
    boxed_ = lambda t: F.concat(F.lit("["), t, F.lit("]"))
    number = lambda t: F.when(F.trim(t).rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), F.trim(t).try_cast("double"))
    rest = F.coalesce(number(a) == number(b), F.lit(False)) | (quoted(a) == quoted(b)) | (boxed_(b) == a) | (boxed_(a) == b) | (F.concat(b, F.lit("?")) == a)
    out = F.when(a == b, True).when(single(a), F.substring(a, 2, 1) == b).when(single(b), F.substring(b, 2, 1) == a).otherwise(rest)
    return F.coalesce(out, F.lit(False))


def over_precise(answer: Column, problem: Column) -> Column:
    """Whether an answer is a decimal of more digits than a problem can ask for.

    Integers, fractions and symbolic forms pass; scientific notation fails if it is next to 0; others
    may have eight digits, zeros at the end not counted, or sixteen where the problem speaks of rounding.
    """
    s = _strip(F.coalesce(answer, F.lit("")))
    any_of = lambda t, words: F.lower(t).rlike("|".join(rf"\Q{w}\E" for w in words))
    value = s.try_cast("double")
    tail = F.rtrim(F.substring(s, F.locate(".", s) + 1, F.length(s)), F.lit("0"))
    digits = F.length(F.regexp_extract(tail, r"^(\d*)", 1))
    most = F.when(any_of(F.coalesce(problem, F.lit("")), ROUNDING_PHRASES), F.lit(LICENSED_DIGITS)).otherwise(F.lit(FLOAT_DIGITS))
    exempt = s.rlike(r"^[+-]?\d+(\s*/\s*[+-]?\d+)?$") | any_of(s, SYMBOLIC_HINTS) | ~F.contains(s, F.lit(".")) | value.isNull()
    return F.when(exempt, False).when(s.rlike(r"^[+-]?\d+(\.\d+)?[eE][+-]?\d+$"), (value != 0) & (F.abs(value) < LEAST_FLOAT)).otherwise(digits > most)


def first_letter(text: Column) -> Column:
    """The first of A to J that occurs anywhere."""
    letters = F.array(*[F.lit(c) for c in LETTERS])
    return F.try_element_at(F.filter(letters, lambda c: F.contains(text, c)), F.lit(1))


def numbers_in(text: Column) -> Column:
    """The parsable integers, decimals and fractions between commas, semicolons and blanks; brackets do not matter."""

    def value(t: Column) -> Column:
        top, low = (F.regexp_extract(t, r"^([+-]?\d+)/(\d+)$", k).try_cast("double") for k in (1, 2))
        return F.coalesce(F.when(t.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double")), F.try_divide(top, low))

    return F.filter(F.transform(F.split(F.translate(text, "{}[]", ""), r"[,;\s]+"), value), lambda x: x.isNotNull())


def shorten(text: Column, limit: int = 140) -> Column:
    t = F.translate(text, "\n", " ")
    return F.when(F.length(t) > limit, F.concat(F.left(t, F.lit(limit)), F.lit("..."))).otherwise(t)


def capped(text: Column, limit: int) -> list[Column]:
    """Text up to a limit, whether it was cut, and its length."""
    return [F.left(text, F.lit(limit)).alias("text"), (F.length(text) > limit).alias("truncated"), F.length(text).alias("chars")]


def after_last(text: Column, mark: str = "####") -> Column:
    return F.trim(F.substring_index(text, mark, -1))


def tag(text: Column, name: str) -> Column:
    """Content of the first <name> element, '' if there is none."""
    return F.trim(F.regexp_extract(text, f"(?s)<{name}>(.*?)</{name}>", 1))


def behaviour_signature(problem: Column, answer: Column) -> Column:
    """Digest of problem and answer; null if either is, as what failed equals nothing."""
    return F.sha2(F.concat(squeeze(problem), F.lit("\x1f"), squeeze(answer)), 256)


def instance_signature(problem: Column, answer: Column) -> Column:
    """Digest of problem and answer; a null differs from an empty text."""
    side = lambda c: F.coalesce(c, F.lit("\x00"))
    return F.sha2(F.concat(side(problem), F.lit("\x1f"), side(answer)), 256)


def lint_reasons(problem: Column, answer: Column, only: tuple[str, ...] | None = None) -> Column:
    """Reasons against an instance, in order; those named in ``only``, or all."""
    checks = [
        (F.coalesce(F.trim(problem), F.lit("")) == "", "empty_problem"),
        (F.coalesce(F.trim(answer), F.lit("")) == "", "empty_answer"),
        (F.length(problem) > 4000, "long_problem"),
        (F.lower(answer).isin("nan", "inf", "none"), "bad_answer"),
        (F.length(F.regexp_extract(answer, r"\.(\d+)", 1)) > 8, "over_precise"),
        (F.contains(problem, F.lit("{")) & F.contains(problem, F.lit("}")), "unfilled_template"),
    ]
    return F.filter(F.array(*[F.when(c, r) for c, r in checks if only is None or r in only]), lambda x: x.isNotNull())
