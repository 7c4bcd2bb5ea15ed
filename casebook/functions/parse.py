"""One parse for every type of field: a reading becomes a value, a text to show, and what is wrong with it.

PARSED is the struct that decisions, answers and evaluation share. ``value`` is the canonical text of the value (ISO dates,
``120/80``, ``true``), ``n`` the number of numeric types; ``marker`` says that a mark stands for a value; ``snapped`` is below
1 where a reading was corrected. The order of tests is part of the meaning: blank, dash, unknown, not done, then the type.

All rungs but similarity are Column expressions. Similarity to a vocabulary is one Arrow function, which sees a text only
where no exact rung holds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from casebook.functions import text as X
from casebook.functions.lexicon import ALIASES, CLOSED, CUTOFF, VOCABULARIES, similar, vocabulary
from casebook.functions.unfold import fold_text

PARSED = "struct<value:string,n:double,display:string,ok:boolean,issues:array<string>,marker:string,snapped:double>"
NUMERIC = ["int", "weeks", "grams", "cm", "days", "float", "kg", "temp"]
UNIT_SHOWN = {"weeks": " SA", "grams": " g", "cm": " cm", "days": " j", "kg": " kg", "temp": " °C"}
FACILITY_CUTOFF, SIGN_CUTOFF, YESNO_CUTOFF = 0.6, 0.6, 0.5


def _parsed(value, n=None, display=None, ok=True, issues=(), marker=None, snapped=1.0) -> Column:
    """A PARSED; issues are columns or texts, of which null ones are left out."""
    col = lambda x, kind: (x if isinstance(x, Column) else F.lit(x)).cast(kind)
    shown = value if display is None else display
    listed = F.array_compact(F.array(*[col(i, "string") for i in issues])) if issues else F.array().cast("array<string>")
    return F.struct(
        col(value, "string").alias("value"), col(n, "double").alias("n"), col(shown, "string").alias("display"), F.lit(ok).alias("ok"),
        listed.alias("issues"), col(marker, "string").alias("marker"), col(snapped, "double").alias("snapped"),
    )


def refused(issue: str) -> Column:
    return _parsed(None, ok=False, issues=[issue])


def shown_number(n: Column) -> Column:
    """A number in plain digits, up to six behind the point; whole ones without a point."""
    plain = F.regexp_replace(n.cast("decimal(30,6)").cast("string"), r"0+$", "")
    return F.when(n == F.floor(n), F.floor(n).cast("string")).otherwise(F.regexp_replace(plain, r"\.$", ""))


def general_number(n: Column) -> Column:
    """A number with six significant digits at most, large and tiny ones by their exponent."""
    fixed = F.format_string("%.6g", n.cast("double"))
    short = F.regexp_replace(F.regexp_replace(fixed, r"(\.\d*?)0+(e|$)", "$1$2"), r"\.(e|$)", "$1")
    return F.when(n == 0, "0").otherwise(short)


def _date(s: Column) -> Column:
    d = X.date_parts(F.regexp_replace(s, r"^\s*M(?=\s*[/.\-])", "11"))
    good = _parsed(d["iso"], display=d["shown"], snapped=F.when(d["mended"], 0.9).otherwise(1.0))
    return F.when(d["iso"].isNotNull(), good).otherwise(refused("could not read as a date (dd/mm/yyyy)"))


def _date_or_year(s: Column, digits: Column) -> Column:
    d = X.date_parts(s)
    year = F.replace(digits, F.lit(" "), F.lit(""))
    return (
        F.when(d["iso"].isNotNull(), _parsed(d["iso"], display=d["shown"]))
        .when(year.rlike(r"^(19|20)\d\d$"), _parsed(year)).otherwise(refused("could not read as a date or year"))
    )


def _pressure(s: Column) -> Column:
    p = X.blood_pressure(s)
    both = F.concat_ws("/", p["systolic"], p["diastolic"])
    return F.when(p["systolic"].isNotNull(), _parsed(both, issues=[p["issue"]])).otherwise(refused("could not read as systolic/diastolic"))


def _weeks_and_days(s: Column) -> tuple[Column, Column]:
    """(whether a reading is weeks and days, its PARSED)."""
    w, d = (X.week_part(s, i) for i in (1, 2))
    n = F.round(w + d / 7, 1)
    return d.between(0, 6), _parsed(n.cast("string"), n, F.format_string("%d SA + %d j", w, d))


def _number(s: Column, digits: Column, dtype: Column, compat: bool) -> Column:
    """Whole and decimal numbers; int keeps its whole part and says what else stands there."""
    t = F.when(dtype == "grams", X.digit_repair(X.gram_mended(s, compat))).otherwise(digits)
    n = X.number(t)
    whole = F.floor(n)
    hot = F.when((dtype == "temp") & (n > 100), n / 10).otherwise(n)
    unit = reduce(lambda c, u: c.when(dtype == u[0], u[1]), UNIT_SHOWN.items(), F.when(F.lit(False), "")).otherwise("")
    extra = F.when(~t.rlike(r"^\s*\d+\s*$"), "unexpected characters around the number")
    return (
        F.when(n.isNull() | X.has_leftover(t), _parsed(None, ok=False, issues=[F.format_string("could not read a number (%s)", dtype)]))
        .when(dtype == "int", _parsed(whole.cast("string"), whole, issues=[extra]))
        .when(dtype.isin("float", "kg", "temp"), _parsed(shown_number(hot), hot, F.concat(general_number(hot), unit)))
        .otherwise(_parsed(shown_number(hot), hot, F.concat(shown_number(hot), unit)))
    )


def _sign(s: Column, near: Column, compat: bool) -> Column:
    g = F.replace(X.fold(s), F.lit(" "), F.lit(""))
    misread, exact = g.rlike(X.MISREAD_NEGATIVE), g.startswith("neg") | (g == "n")
    no, yes = (lambda v: _parsed("negative", display="Négatif", snapped=v)), (lambda v: _parsed("positive", display="Positif", snapped=v))
    rungs = [(misread, no(0.7)), (exact, no(1.0))] if compat else [(exact, no(1.0)), (misread, no(0.7))]
    rungs.append((g.startswith("pos") | g.startswith("+") | g.endswith("+"), yes(1.0)))
    rungs += [(near["word"] == "Neg", no(near["near"])), (near["word"] == "Pos", yes(near["near"]))]
    return reduce(lambda c, r: c.when(*r), rungs[1:], F.when(*rungs[0])).otherwise(refused("expected Neg/Pos"))


def _yes_no(s: Column, near: Column) -> Column:
    g = F.btrim(X.fold(s), F.lit(" .,"))
    say = lambda v, score: _parsed("true" if v else "false", display="Oui" if v else "Non", snapped=score)
    first = F.substring(g, 1, 1)
    return (
        F.when(g == "oui", say(True, 1.0)).when(g == "non", say(False, 1.0))
        .when(g.isin(X.YES_WORDS), say(True, 1.0)).when(g.startswith("rec"), say(True, 0.8))
        .when((near["received"] >= 0.7) | g.rlike(r"^[rpkh][ea][cs]"), say(True, 0.75))
        .when(g.isin(X.NO_WORDS) | g.startswith("neg"), say(False, 1.0))
        .when((first == "n") & (F.char_length(g) <= 4), say(False, near["own"])).when((first == "o") & (F.char_length(g) <= 4), say(True, near["own"]))
        .when(near["word"] == "Oui", say(True, near["near"])).when(near["word"] == "Non", say(False, near["near"]))
        .otherwise(refused("expected Oui/Non"))
    )


def _sex(s: Column) -> Column:
    return F.when(X.sex(s).isNotNull(), _parsed(X.sex(s))).otherwise(refused("expected F/M"))


def _in_vocabulary(v: Column, name: Column, vocabularies: dict[str, list[str]]) -> Column:
    """Whether a text's folded form is one of the vocabulary's (null without a vocabulary)."""
    folded = X.fold(v)
    rungs = [(name == n, folded.isin([fold_text(w) for w in words])) for n, words in vocabularies.items()]
    return reduce(lambda c, r: c.when(*r), rungs[1:], F.when(*rungs[0]))


def _free_text(s: Column, key: Column, dtype: Column, name: Column, near: Column, vocabularies: dict[str, list[str]]) -> Column:
    head, rest = F.substring_index(s, " ", 1), F.regexp_extract(s, r"^\S+ (.+)$", 1)
    prefixed = (key == "facility_name") & (rest != "") & (F.char_length(head) <= 5) & (near["word"] != head)
    named = F.concat_ws(" ", near["word"], rest)
    v = F.regexp_replace(F.when((key == "facility_name") | near["word"].isNull(), s).otherwise(near["word"]), X.ARTICLE, "Al")
    snapped = F.when((key == "facility_name") | near["near"].isNull(), 1.0).otherwise(near["near"])
    strange = name.isNotNull() & ~_in_vocabulary(v, name, vocabularies)
    letters = F.char_length(F.regexp_replace(v, r"[^A-Za-zÀ-ÿ]", ""))
    issue = F.when(strange & key.isin(CLOSED), "not a known value for this field").when(strange & letters.between(1, 4) & ~v.rlike(r"\d"), "unrecognised short word")
    return (
        F.when(prefixed, _parsed(named, snapped=near["near"])).when(dtype == "code", _parsed(X.code(s)))
        .when(name.isNotNull() & s.rlike(X.MISREAD_RAS) & (X.fold(s) != "ras"), _parsed("RAS", snapped=0.7))
        .otherwise(_parsed(v, issues=[issue], snapped=snapped))
    )


def parse(rows: DataFrame, compat: bool = False, vocabularies: dict[str, list[str]] = VOCABULARIES, out: str = "parsed") -> DataFrame:
    """``rows`` (raw, key, dtype, lo, hi) with PARSED in ``out``. An unknown type takes any text; a blank reading is not ok
    and has no issue; a number outside lo to hi keeps its value and gets an issue."""
    raw, key, dtype = F.col("raw"), F.col("key"), F.col("dtype")
    free = dtype.isin("str", "code")
    name = F.when(free & (key == "facility_name"), "facility").when(dtype == "str", vocabulary(key)).when(dtype == "posneg", "sign").when(dtype == "yesno", "yesno")
    marked = rows.withColumns({"_s": X.squeeze(raw), "_mark": X.marker(raw), "_name": name, "_digits": X.digit_repair(X.squeeze(raw))})
    s, mark, name, digits = (F.col(c) for c in ("_s", "_mark", "_name", "_digits"))
    asked = F.when(X.is_blank(raw) | mark.isNotNull() | name.isNull(), None).when(name == "facility", F.substring_index(s, " ", 1)).otherwise(s)
    cutoff = F.when(name == "facility", FACILITY_CUTOFF).when(name == "sign", SIGN_CUTOFF).when(name == "yesno", YESNO_CUTOFF).otherwise(CUTOFF)
    compared = marked.withColumn("_near", similar(asked, name, cutoff, vocabularies))
    near = F.col("_near")
    is_weeks, weeks = _weeks_and_days(s)
    vocab = F.when(key != "facility_name", name)
    typed = (
        F.when(free, _free_text(s, key, dtype, vocab, near, vocabularies))
        .when(dtype == "date", _date(s)).when(dtype == "date_or_year", _date_or_year(s, digits)).when(dtype == "bp", _pressure(s))
        .when((dtype == "weeks") & is_weeks, weeks).when(dtype.isin(NUMERIC), _number(s, digits, dtype, compat))
        .when(dtype == "posneg", _sign(s, near, compat)).when(dtype == "yesno", _yes_no(s, near)).when(dtype == "sex", _sex(s))
        .otherwise(_parsed(s))
    )
    whole = (
        F.when(X.is_blank(raw), _parsed(None, ok=False))
        .when(mark == "dash", _parsed(None, display="—", marker="dash")).when(mark == "unknown", _parsed(None, display="?", marker="unknown"))
        .when(mark == "not_done", _parsed(None, display="NF (non fait)", marker="not_done")).otherwise(typed)
    )
    staged = compared.withColumn("_p", whole)
    n, bounds = F.col("_p.n"), F.format_string("out of plausible range (%s–%s)", general_number(F.col("lo")), general_number(F.col("hi")))
    outside = F.col("_p.ok") & (n < F.col("lo")) | (n > F.col("hi"))
    issues = F.when(F.coalesce(outside, F.lit(False)), F.array_append("_p.issues", bounds)).otherwise(F.col("_p.issues"))
    return staged.withColumn(out, F.col("_p").withField("issues", issues)).drop("_s", "_mark", "_name", "_digits", "_near", "_p")


def same_value(a: Column, b: Column, na: Column, nb: Column) -> Column:
    """Whether two parsed values are equal: numbers within a millionth, texts folded without marks."""
    plain = lambda x: F.regexp_replace(X.fold(x), r"[^\p{L}\p{N}_]", "")
    return F.coalesce(F.when(na.isNotNull() | nb.isNotNull(), F.abs(na - nb) < 1e-6).otherwise(plain(a) == plain(b)), F.lit(False))


def canonical_alias(v: Column) -> Column:
    """The canonical spelling of a value."""
    return F.coalesce(reduce(lambda c, a: c.when(v == a[0], a[1]), ALIASES.items(), F.when(F.lit(False), "")), v)
