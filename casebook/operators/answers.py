"""What a reviewer types: typed against the field's definition, applied all or nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from casebook.functions.parse import parse
from casebook.functions.text import TYPED_NO, TYPED_YES, UNKNOWN

#: Fixed value: white space at both ends of an answer.
BLANKS = " \t\n\x0b\x0c\r"
#: What stands in a field's issues after an answer.
CONFIRMED, SET, ENTERED, KEPT = "confirmed by midwife", "set by midwife", "entered by midwife", "kept as typed"


def _answer(status: str | None, value=None, shown=None, issues=None, reason=None) -> Column:
    col = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("string")
    return F.struct(
        col(status).alias("status"), col(value).alias("value"), col(shown).alias("display"),
        (F.array().cast("array<string>") if issues is None else issues).alias("issues"), col(reason).alias("reason"),
    )


def typed_answers(rows: DataFrame, compat: bool = False, out: str = "answer") -> DataFrame:
    """``rows`` (text, key, kind, dtype, lo, hi, options) with struct(status, value, display, issues, reason): a null status
    refuses the answer, for the reason given.

    A null kind takes any text. Boxes take yes or no words, choices one of their options whatever its case, texts what
    their type parses to; free texts and codes that do not parse are kept as typed. A not-done mark is not applicable
    (``compat``: known without a value, as the system studied has it)."""
    text = F.btrim(F.col("text"), F.lit(BLANKS))
    parsed = parse(rows.withColumn("raw", text), out="_parsed")
    p, low, kind, dtype = F.col("_parsed"), F.lower(text), F.col("kind"), F.col("dtype")
    choice = F.get(F.filter("options", lambda o: F.lower(o) == low), F.lit(0))
    box = F.when(low.isin(TYPED_YES), _answer("KNOWN", "true", "☑")).when(low.isin(TYPED_NO), _answer("KNOWN", "false", "☐")).otherwise(_answer(None, reason="answer yes or no"))
    pick = F.when(choice.isNotNull(), _answer("KNOWN", choice, choice)).otherwise(_answer(None, reason=F.concat(F.lit("choose one of: "), F.array_join("options", ", "))))
    free = (
        F.when(p["marker"] == "unknown", _answer("UNKNOWN", None, "?")).when(p["marker"] == "dash", _answer("NOT_APPLICABLE", None, "—"))
        .when(p["marker"] == "not_done", _answer("KNOWN" if compat else "NOT_APPLICABLE", None, p["display"], p["issues"]))
        .when(p["ok"], _answer("KNOWN", p["value"], p["display"], p["issues"]))
        .when(dtype.isin("str", "code"), _answer("KNOWN", text, text, F.array(F.lit(KEPT))))
        .otherwise(_answer(None, reason=F.coalesce(F.nullif(F.array_join(p["issues"], "; "), F.lit("")), F.format_string("expected a %s value", dtype))))
    )
    answer = (
        F.when(F.coalesce(text, F.lit("")) == "", _answer(None, reason="empty answer")).when(low.isin(UNKNOWN), _answer("UNKNOWN", None, "?"))
        .when(kind.isNull(), _answer("KNOWN", text, text)).when(kind == "check", box).when(kind == "radio", pick).otherwise(free)
    )
    return parsed.withColumn(out, answer).drop("_parsed", "raw" if "raw" not in rows.columns else "_parsed")


def judged_answers(fields: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers (page, key, confirm, text, new_status) with struct ``answer``; a reason stands where one is refused. Of several
    answers to one field the greatest counts. They are aggregated by field, which also keeps the optimiser from pushing
    tests of the reason through the whole parse."""
    defined = fields.select("page", "key", "kind", "dtype", "lo", "hi", "options", F.lit(True).alias("_there"))
    asked = answers.join(defined, ["page", "key"], "left")
    typed = typed_answers(asked)
    simple = F.coalesce("confirm", F.lit(False)) | F.col("new_status").isNotNull()
    reason = F.when(F.col("_there").isNull(), "unknown field").when(~simple, F.col("answer.reason"))
    one = typed.select("page", "key", F.struct("confirm", "text", "new_status", "answer", reason.alias("reason")).alias("j"))
    return one.groupBy("page", "key").agg(F.max("j").alias("j")).select("page", "key", "j.*")


def apply_answers(fields: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fields after the answers, refused answers with their reason). A page with one refused answer keeps all its fields;
    other pages' answers are applied. ``fields``: page, key, kind, dtype, lo, hi, options, value, display, raw, status,
    confidence, issues; a confirmed value is kept, a status clears it, a text replaces it."""
    judged = judged_answers(fields, answers)
    refused = judged.where("reason IS NOT NULL")
    taken = judged.join(refused.select("page").distinct(), "page", "left_anti").withColumnsRenamed({"text": "_text", "confirm": "_confirm", "new_status": "_status", "answer": "_answer"}).drop("reason")
    rows = fields.join(taken, ["page", "key"], "left")
    confirm, chosen, hit = F.coalesce("_confirm", F.lit(False)), F.col("_status").isNotNull(), F.col("_answer").isNotNull()
    a = lambda c: F.col(f"_answer.{c}")
    pick = lambda old, confirmed, set_, entered: F.when(~hit, old).when(confirm, confirmed).when(chosen, set_).otherwise(entered)
    old = {c: F.col(c) for c in ("value", "display", "raw", "status", "confidence", "issues")}
    one = lambda t: F.array(F.lit(t))
    return rows.withColumns({
        "value": pick(old["value"], old["value"], F.lit(None), a("value")),
        "display": pick(old["display"], old["display"], F.when(F.col("_status") == "UNKNOWN", "?").when(F.col("_status") == "NOT_APPLICABLE", "—"), a("display")),
        "raw": pick(old["raw"], old["raw"], old["raw"], F.btrim("_text", F.lit(BLANKS))),
        "status": pick(old["status"], F.lit("KNOWN"), F.col("_status"), a("status")),
        "confidence": F.when(hit, 1.0).otherwise(old["confidence"]),
        "issues": pick(old["issues"], F.concat(F.filter("issues", lambda i: ~F.contains(i, F.lit("confirm"))), one(CONFIRMED)), one(SET), F.concat(one(ENTERED), a("issues"))),
        "corrected": hit,
    }).drop("_confirm", "_text", "_status", "_answer"), refused


def apply_batch(fields: DataFrame, answers: DataFrame) -> DataFrame:
    """``apply_answers`` of one batch: ValueError where any of its answers is refused, and nothing is applied."""
    after, refused = apply_answers(fields, answers)
    bad = refused.select("page", "key", "reason").limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r.page}.{r.key}: {r.reason}" for r in bad))
    return after
