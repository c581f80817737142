"""Queries over answers, programs and problems of many shapes, made from the conversations' numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import source, symbolic, validity
from ..functions import text as X
from .registry import query
from .views import table

_N = "WITH n AS (SELECT conv_id, turn, length(text) AS n, (conv_id + turn) AS k FROM conversations)"


def _shapes(spark, d, shapes):
    """(conv_id, turn, n, k, s): one of the shapes by k; braces {n} and {k} stand for the numbers."""
    t = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("n"), (F.col("conv_id") + F.col("turn")).alias("k"))
    s = F.element_at(F.array(*[F.lit(x) for x in shapes]), (F.col("k") % len(shapes) + 1).cast("int"))
    for name in ("n", "k"):
        s = F.replace(s, F.lit(f"<{name}>"), F.col(name).cast("string"))
    return t.withColumn("s", s)


def _case(values):
    """SQL over n and k, a value for each shape."""
    return f"CASE k % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


_BRACKETS = ["[0,<n>)", "(<n>]", "{(<n>)}", " {[(A b.)]}. ", "1,<n>..", "(x) + (<n>)", "[(<n>]", "{}"]


@query("g9_mixed_brackets", f"{_N} SELECT conv_id, turn, " + _case(["'[0' || n || ')'", "'(' || n || ']'", "n::VARCHAR", "'{[(ab.)]}'", "'1' || n", "'x)+(' || n", "'(' || n", "''"]) + " AS got FROM n")
def mixed_brackets(spark, d):
    t = _shapes(spark, d, _BRACKETS)
    return t.select("conv_id", "turn", X.normalize_answer(F.col("s")).alias("got"))


_NESTED = [r"\boxed{a{b{<n>}c}d} end", r"no box <n>", r"\boxed{<n>} then \boxed{ {x} }", r"\boxed{{{{<n>}}}}"]


@query("g3_boxed_deep", f"{_N} SELECT conv_id, turn, " + _case(["'a{b{' || n || '}c}d'", "NULL", "' {x} '", "NULL"]) + " AS got FROM n")
def boxed_deep(spark, d):
    return _shapes(spark, d, _NESTED).select("conv_id", "turn", X.boxed_deep(F.col("s")).alias("got"))


@query("g4_boxed_flat", f"{_N} SELECT conv_id, turn, " + _case(["NULL", "NULL", "n::VARCHAR", "NULL"]) + " AS got FROM n")
def boxed_flat(spark, d):
    return _shapes(spark, d, _NESTED).select("conv_id", "turn", X.boxed_flat(F.col("s")).alias("got"))


_FINALS = ["The answer is: <n>\nFinal Answer: <k>\n", "The answer is:<n>\n", "Final Answer: <n>", "Final Answer: 1\nFinal Answer: <n>\n"]


@query("g5_final_answer", f"{_N} SELECT conv_id, turn, " + _case(["' ' || k", "n::VARCHAR", "NULL", "' ' || n"]) + " AS got FROM n")
def final_answer(spark, d):
    return _shapes(spark, d, _FINALS).select("conv_id", "turn", X.final_answer(F.col("s")).alias("got"))


_CHATS = [
    "<|im_start|>user \\boxed{1}<|im_end|><|im_start|>assistant so \\boxed{<n>}",
    "User: x Assistant: \\boxed{<n>}<|im_end|> \\boxed{2}",
    "Final Answer: <n>\n</s> \\boxed{3}",
    "\\boxed{} The answer is: <n>\n",
]


@query("g6_solution", f"{_N} SELECT conv_id, turn, " + _case(["n::VARCHAR", "n::VARCHAR", "NULL", "' ' || n"]) + " AS got FROM n")
def solution(spark, d):
    """What follows a stop word is cut and trimmed, so a final answer that ended its line there is lost, as asked."""
    return _shapes(spark, d, _CHATS).select("conv_id", "turn", X.solution(F.col("s")).alias("got"))


_CHOICES = ["$$ \\boxed{(B) <n>} $$", "Final Answer: C.", "so \\boxed{<n>}", "\\boxed{A} \\boxed{B}"]


@query("g7_choice_letter", f"{_N} SELECT conv_id, turn, " + _case(["'B'", "NULL", "NULL", "'A'"]) + " AS got FROM n")
def choice(spark, d):
    return _shapes(spark, d, _CHOICES).select("conv_id", "turn", X.choice_letter(F.col("s")).alias("got"))


@query("g16_fractions", f"{_N} SELECT conv_id, turn, " + _case(["n + 0.5::DOUBLE", "n / 4.0::DOUBLE", "0::DOUBLE", "n + 100.0::DOUBLE"]) + " AS total FROM n")
def fractions(spark, d):
    v = X.numbers_in(F.col("s"))
    t = _shapes(spark, d, ["{<n>, abc; .5}", "[<n>/4]", "x/y 3/0", "1e2 <n>"])
    return t.select("conv_id", "turn", F.aggregate(v, F.lit(0.0), lambda a, x: a + x).alias("total"))


_FLOATS = ["<n>", "1/<n>", "0.123456789<n>1", "0.5000000000000", "sqrt(2.123456789123)", "1.5e-12", "2.5e3", "x.123456789"]


@query("g23_over_precise", f"{_N} SELECT conv_id, turn, " + _case(["false", "false", "true", "false", "false", "true", "false", "false"]) + " AS plain, k % 8 = 5 OR (k % 8 = 2 AND length(n::VARCHAR) + 10 > 16) AS licensed FROM n")
def over_precise(spark, d):
    t = _shapes(spark, d, _FLOATS)
    return t.select("conv_id", "turn", X.over_precise(F.col("s"), F.lit("")).alias("plain"), X.over_precise(F.col("s"), F.lit("Round to many decimal places")).alias("licensed"))


_PROGRAMS = ["import x\nKIND = ' a<n> '  # k\nKIND = 'b'\n", "KIND: str = \"b<n>\"", "  KIND = 'inner'", "kind = 'c'\nOTHER = 'd'"]


@query("g28_string_constant", f"{_N} SELECT conv_id, turn, " + _case(["'a' || n", "'b' || n", "NULL", "NULL"]) + " AS got FROM n")
def constant(spark, d):
    return _shapes(spark, d, _PROGRAMS).select("conv_id", "turn", source.constant(F.col("s"), "KIND").alias("got"))


@query("g29_concept_fallback", "SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN 'meta' END, CASE WHEN event_id % 3 = 1 THEN 'declared' END, 'of ' || event_type) AS got FROM events")
def concept_fallback(spark, d):
    """Metadata, else what the program declares, else the group of its type; empty texts count as missing."""
    e = F.col("event_id") % 3
    meta, declared = F.when(e == 0, "meta").otherwise(""), F.when(e == 1, "declared").otherwise("")
    kinds = table(spark, d, "events").select("event_type").distinct().withColumn("kind", F.concat(F.lit("of "), "event_type"))
    rows = table(spark, d, "events").join(kinds, "event_type", "left")
    return rows.select("event_id", F.coalesce(F.nullif(meta, F.lit("")), F.nullif(declared, F.lit("")), "kind").alias("got"))


@query("p10_concept_declaration", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'missing type' WHEN event_id % 4 = 1 THEN 'missing group' WHEN event_type NOT IN ('click', 'view') THEN 'unknown group: ' || event_type END AS reason FROM events")
def concept_declaration(spark, d):
    """The first reason against a declaration."""
    known = F.array(F.lit("click"), F.lit("view"))
    kind = F.when(F.col("event_id") % 4 != 0, "t")
    group = F.when(F.col("event_id") % 4 != 1, F.col("event_type"))
    reason = (
        F.when(F.coalesce(kind, F.lit("")) == "", "missing type")
        .when(F.coalesce(group, F.lit("")) == "", "missing group")
        .when(~F.array_contains(known, group), F.concat(F.lit("unknown group: "), group))
    )
    return table(spark, d, "events").select("event_id", reason.alias("reason"))


@query("j11_axis_label", "WITH a AS (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INT) AS bin FROM (SELECT DISTINCT event_type FROM events)) SELECT event_id, bin FROM events JOIN a USING (event_type)")
def axis_label(spark, d):
    """Bins of labels by a dimension of the ordered labels."""
    e = table(spark, d, "events").select("event_id", "event_type")
    labels = e.select("event_type").distinct().agg(F.array_sort(F.collect_list("event_type")).alias("labels"))
    return e.join(F.broadcast(labels)).select("event_id", (F.array_position("labels", F.col("event_type")) - 1).cast("int").alias("bin"))


@query("m12_unknown_labels", "SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY event_type")
def unknown_labels(spark, d):
    """Rows whose label has no bin, set apart instead of ending the run."""
    at = F.array_position(F.array(F.lit("click"), F.lit("view")), F.col("event_type"))
    return table(spark, d, "events").where(at == 0).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("p18_axis_labels", "SELECT CAST(i AS INT) AS bin, coalesce(['number_theory', 'combinatorics', 'sequence'][i + 1], 'D' || i) AS label FROM range(6) t(i)")
def axis_labels(spark, d):
    """Ordered labels; bins beyond them have a name of their own."""
    names = F.array(*[F.lit(x) for x in ("number_theory", "combinatorics", "sequence")])
    i = F.col("id").cast("int")
    return spark.range(6).select(i.alias("bin"), F.coalesce(F.get(names, i), F.concat(F.lit("D"), i.cast("string"))).alias("label"))


_PREDICTED = ["The answer is: (a).", "$\\boxed{<n>}$", "**<n>.0**", "'<n>'", "[<n>]", "<n>?", "it's\nmore", "(<n>)"]


@query("g14_cleaned_match", f"{_N} SELECT conv_id, turn, " + _case(["n = -1", "true", "true", "true", "true", "true", "false", "length(n::VARCHAR) = 1"]) + " AS same, k % 8 = 0 AS letter FROM n")
def cleaned_match(spark, d):
    t = _shapes(spark, d, _PREDICTED).withColumn("p", X.prediction(F.col("s")))
    return t.select("conv_id", "turn", X.fuzzy_equal(F.col("p"), F.col("n").cast("string")).alias("same"), X.fuzzy_equal(F.col("p"), F.lit("a")).alias("letter"))


_PROBLEMS = [
    ("Show that <n> > <k> holds.", "n <= k"),
    ("Numbers <n> and <k>; their gcd(a, b) = 6.", "n > 0 AND k > 0 AND (n % 6 <> 0 OR k % 6 <> 0)"),
    ("A triangle has sides 3 and <n>. Find its area.", "true"),
    ("A right triangle has sides 3 and <n>. Find its area.", "false"),
    ("Find the sum of the first <k> terms.", "k <= 2"),
    ("A committee of size <k> from a group of <n> people.", "n = k OR k = 0"),
    ("The arithmetic mean of a = <n>, b = <k>.", "n = k"),
    ("Compute \\frac25002 and <n>.", "true"),
    ("Are <n> and <k> coprime?", "true"),
    ("A polygon with <k> sides.", "k <= 2"),
    ("Let a = 7, given that the value is <n>.", "n >= 2"),
    ("What is <n> + <k>?", "false"),
]


@query("g18_validity_rules", f"{_N} SELECT conv_id, turn, " + _case([x for _, x in _PROBLEMS]) + " AS broken FROM n")
def validity_rules(spark, d):
    """Each shape breaks one rule or none; the answer is n."""
    t = _shapes(spark, d, [x for x, _ in _PROBLEMS])
    return t.select("conv_id", "turn", validity.looks_broken(F.col("s"), F.col("n").cast("string")).alias("broken"))


@query("g20_strict_verify", f"{_N}, v AS (SELECT conv_id, turn, n, " + _case([x for _, x in _PROBLEMS]) + " AS broken FROM n) SELECT conv_id, count(*) >= 2 AND count(DISTINCT n) > 1 AND NOT bool_or(broken) AS accepted FROM v GROUP BY conv_id")
def strict_verify(spark, d):
    """All instances of a program sound, and more than one of them different."""
    t = _shapes(spark, d, [x for x, _ in _PROBLEMS]).withColumn("broken", validity.looks_broken(F.col("s"), F.col("n").cast("string")))
    ok = (F.count(F.lit(1)) >= 2) & (F.count_distinct("n") > 1) & ~F.bool_or("broken")
    return t.groupBy("conv_id").agg(ok.alias("accepted"))


@query("g31_feedback", "WITH p AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS p FROM events) SELECT event_id, CASE WHEN p > 0.7 THEN 'too easy' WHEN p < 0.2 THEN 'too hard' ELSE 'good band' END AS band FROM p")
def feedback(spark, d):
    p = F.get_json_object("props", "$.k").cast("double") / 100
    return table(spark, d, "events").select("event_id", F.when(p > 0.7, "too easy").when(p < 0.2, "too hard").otherwise("good band").alias("band"))


@query("a22_recovered", f"{_N} SELECT conv_id, turn, " + _case(["true", "false", "false", "true"]) + " AS recovered FROM n")
def recovered(spark, d):
    """Predictions that round to a reference with decimals."""
    t = _shapes(spark, d, ["<n>.254", "<n>.256", "<n>", "$<n>.2451$"])
    ref = F.concat(F.col("n").cast("string"), F.lit(".25"))
    return t.select("conv_id", "turn", X.rounding_recovered(F.col("s"), ref).alias("recovered"))


_SHOTS = "PARENT_EXAMPLE_1: <n>\nCHILD_EXAMPLE_2: z\nCHILD_EXAMPLE_1: <k>\nPARENT_EXAMPLE_3: p\nCHILD_EXAMPLE_1: last<k>\n"


@query("j10_few_shot_pairs", f"{_N} SELECT conv_id, turn, 1 AS shot, n::VARCHAR AS parent, 'last' || k AS child FROM n")
def few_shot(spark, d):
    """Examples of two kinds, joined by their number; the last of a number counts."""

    def by_number(kind):
        keys, values = (F.regexp_extract_all("s", F.lit(rf"{kind}_EXAMPLE_(\d+): ([^\n]*)"), F.lit(g)) for g in (1, 2))
        return F.arrays_zip(keys.alias("k"), values.alias("v"))

    t = _shapes(spark, d, [_SHOTS]).withColumns({"a": by_number("PARENT"), "b": by_number("CHILD")})
    last = lambda c: F.transform(F.array_distinct(F.transform(c, lambda x: x["k"])), lambda k: F.element_at(F.filter(c, lambda x: x["k"] == k), -1))
    t = t.select("conv_id", "turn", F.explode(last(F.col("a"))).alias("x"), last(F.col("b")).alias("b"))
    t = t.select("conv_id", "turn", "x", F.explode("b").alias("y")).where("x.k = y.k")
    return t.select("conv_id", "turn", F.col("x.k").cast("int").alias("shot"), F.col("x.v").alias("parent"), F.col("y.v").alias("child"))


#: (reply, reference answer, SQL of whether they are the same).
_GRADED = [
    (r"so \boxed{\frac{<n>}{2}}.", "<n>/2", "true"),
    (r"\boxed{\sqrt{<n>} \cdot \sqrt{<n>}}", "<n>", "true"),
    (r"\boxed{(x+<n>)^2}", "x^2+2*<n>x+<n>^2", "true"),
    (r"\boxed{[0,<n>)}", "[0,<n>]", "false"),
    (r"\boxed{\{-1,<n>\}}", r"\{<n>, -1\}", "true"),
    (r"\boxed{<n>}", "<k>", "n = k"),
    ("no box <n>", "<n>", "false"),
    (r"\boxed{\dfrac{<n>}{<k>}}", "<k>/<n>", "n = k"),
    (r"\boxed{\left(-\infty, <n>\right] \cup [<n>.5, <n>.75)}", r"[<n>\frac{1}{2},<n>+\frac34)\cup(-\infty,<n>]", "true"),
    (r"\boxed{<n>^2 - <k>^2}", "(<n>-<k>)(<n>+<k>)", "true"),
    (r"\boxed{<n>\pi}", "<n>*3.14159", "false"),
    (r"\boxed{x = <n>\%}", "<k>", "n = k"),
    (r"\boxed{\sin^2(<n>) + \cos^2(<n>)}", "1", "true"),
    (r"\boxed{\frac{<n>}{}}", "<n>", "false"),
]


@query("g13_symbolic_equality", f"{_N} SELECT conv_id, turn, " + _case([w for _, _, w in _GRADED]) + " AS correct FROM n")
def symbolic_equality(spark, d):
    """Whether the boxed answer of a reply and the reference are the same number, expression, interval or set."""
    t = _shapes(spark, d, [f"{reply}|{truth}" for reply, truth, _ in _GRADED])
    reply, truth = F.split_part("s", F.lit("|"), F.lit(1)), F.split_part("s", F.lit("|"), F.lit(2))
    return t.select("conv_id", "turn", symbolic.same(X.boxed_greedy(reply), truth).alias("correct"))
