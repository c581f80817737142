"""Queries over program sources that hold the documents' texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import source as S
from .registry import query
from .views import table

_BODY = "import random\ndef generate(seed):\n    rng = random.Random(seed)\n"
#: What follows the text, by doc_id; ``<t>`` stands for the document's source.
_ENDS = [
    ("    return rng.random(), '<t>'\n", []),
    ("    return random.choice([1]), '<t>'\n", ["unseeded_call:random.choice"]),
    ("    while True:\n        seed += 1\nimport <t>\n", ["import:<t>", "endless_loop:while"]),
    ("    while True:\n        if seed: break\nfrom sympy import randprime, <t>\n<t>.run(np.random.rand(2))\n", ["unseeded_import:sympy.randprime", "top_level_statement:Expr", "unseeded_call:np.random.rand"]),
    ("    return os.urandom(3)\nfor <t> in seed: pass\n", ["forbidden_text:os.", "top_level_statement:For", "unseeded_call:os.urandom"]),
    ("return <t>(:\n", None),
]


def _sources(spark, d, head=""):
    """(doc_id, source_code): a program whose note is the document's whole text."""
    note = F.translate(F.coalesce("text", F.lit("")), '\\"\x00', "...")
    name = F.concat(F.lit("m_"), F.regexp_replace(F.lower(F.coalesce("source", F.lit("none"))), "[^a-z0-9]", "_"))
    end = F.element_at(F.array(*[F.lit(e) for e, _ in _ENDS]), (F.col("doc_id") % len(_ENDS) + 1).cast("int"))
    code = F.concat(F.lit(head + 'NOTE = """'), note, F.lit('"""\n' + _BODY), F.replace(end, F.lit("<t>"), name))
    return table(spark, d, "documents").select("doc_id", name.alias("t"), code.alias("source_code"))


_NAMES = """t AS (SELECT doc_id, doc_id % 6 AS k, translate(coalesce(text, ''), '\\"' || chr(0), '...') AS note, 'm_' || regexp_replace(lower(coalesce(source, 'none')), '[^a-z0-9]', '_', 'g') AS t FROM documents)"""


def _sql_text(s: str) -> str:
    return " || chr(10) || ".join("'" + line.replace("'", "''") + "'" for line in s.split("\n"))


def _found_sql() -> str:
    """Findings of the ends, after the forbidden texts that the note or the end contains."""
    forbidden = ", ".join(f"'{x}'" for x in S.FORBIDDEN)
    texts = " ".join(f"WHEN {k} THEN {_sql_text(e)}" for k, (e, _) in enumerate(_ENDS))
    rest = " ".join(f"WHEN {k} THEN [{', '.join(repr(f) for f in found if not f.startswith('forbidden'))}]" for k, (_, found) in enumerate(_ENDS) if found is not None)
    return f"""WITH {_NAMES}, e AS (SELECT *, lower(note || replace(CASE k {texts} END, '<t>', t)) AS low FROM t)
SELECT doc_id, CASE WHEN k = 5 THEN 'syntax' ELSE array_to_string(list_concat(list_transform(list_filter([{forbidden}], lambda x: contains(low, x)), lambda x: 'forbidden_text:' || x),
  list_transform(CASE k {rest} END, lambda x: replace(x, '<t>', t))), ' ') END AS findings FROM e"""


@query("g24_source_lint", _found_sql())
def source_lint(spark, d):
    """What is wrong with each program, in order of the rules; of a syntax error the rule alone."""
    f = F.transform(S.lint("source_code"), lambda x: F.when(x["rule"] == "syntax", x["rule"]).otherwise(F.concat_ws(":", x["rule"], x["detail"])))
    return _sources(spark, d).select("doc_id", F.array_join(f, " ").alias("findings"))


_HEAD = "CONCEPT_GROUP = 'number'  # first\nCONCEPT_TYPE: str = (\n    'prime')\nx = 1; CONCEPT_REASON = 'because'\n"


def _kept_sql() -> str:
    text = _sql_text
    ends = " ".join(f"WHEN {k} THEN {text(e)}" for k, (e, _) in enumerate(_ENDS))
    mid = f"'NOTE = \"\"\"' || note || '\"\"\"' || chr(10) || {text(_BODY)} || replace(CASE k {ends} END, '<t>', t)"
    return f"""WITH {_NAMES} SELECT doc_id, md5(CASE WHEN k = 5 THEN {text(_HEAD)} || {mid} ELSE 'x = 1' || chr(10) || {mid} || 'CONCEPT_GROUP = ''number''' || chr(10) END) AS kept FROM t"""


@query("g27_without_labels", _kept_sql())
def without_labels(spark, d):
    """Programs without their labels, the group declared last; those that do not parse as they are."""
    return _sources(spark, d, _HEAD).select("doc_id", F.md5(S.stripped(F.col("source_code")).cast("binary")).alias("kept"))
