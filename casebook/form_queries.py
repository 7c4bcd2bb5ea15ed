"""Queries over forms: parsing, answers, views, evaluation and layouts, each with SQL written from the rules of the form."""

from __future__ import annotations

import difflib

from pyspark.sql import DataFrame, Window, functions as F

from casebook import catalog
from casebook.functions import lexicon, text as X
from casebook.functions.parse import NUMERIC, UNIT_SHOWN, parse
from casebook.functions.unfold import fold_text
from casebook.operators import answers, control, decide, evaluate, geometry, match, records
from casebook.queries import FOLD, LIST, NUM, READINGS, REPAIR, SQUEEZE, _MENDED, _GRAM, _WD, _quote, _values, query
from casebook.session import table

# ---- parse: every reading as every type

KINDS = [
    ("str", "conjunctivae", None, None), ("str", "profession", None, None), ("str", "region", None, None), ("str", "facility_name", None, None), ("str", "visits.m7.examined_by", None, None), ("code", "record_number", None, None),
    ("date", "lmp_date", None, None), ("date_or_year", "date", None, None), ("bp", "blood_pressure", None, None), ("weeks", "ga", 4.0, 44.0), ("int", "age", 12.0, 55.0), ("grams", "birth_weight_g", 300.0, 6500.0), ("cm", "height_cm", 120.0, 200.0),
    ("days", "age", 0.0, 120.0), ("float", "hemoglobin_g_dl", 5.0, 16.0), ("kg", "weight_kg", 30.0, 160.0), ("temp", "temperature_c", 34.0, 42.0), ("posneg", "hiv", None, None), ("yesno", "iron", None, None), ("sex", "newborn_sex", None, None), ("other", "x", None, None),
]
WRITTEN = [r for r in READINGS] + ["Normawx", "normal", "Colores", "agricultrise", "Couturier", "Fes-Meknes", "Rabat", "CSA Hay Salam", "DR", "dr Ouled", "Dr. Ben AI Haj", "AI Hoceima", "xyz", "wxy1", "Pales", "7AS", "mig.", "nég.", "Ras", "1l", "pozitif"]


def _plain_snap(word: str, words: list[str], cutoff: float) -> tuple[str, float]:
    """Ranked as the form's rules have it: by likeness, then by the later spelling."""
    forms = {fold_text(w): lexicon.ALIASES.get(w, w) for w in words}
    key = fold_text(word)
    if key in forms:
        return forms[key], 1.0
    (best, a), (next_, b) = sorted(((difflib.SequenceMatcher(None, key, f).ratio(), f) for f in forms), reverse=True)[:2]
    if best < cutoff:
        return word, 1.0
    return forms[a], best * (0.6 if best - next_ < 0.05 and forms[a] != forms[b] else 1.0)


def _likeness() -> list[tuple]:
    """(vocabulary, text, word, near, received, own) of the written texts, which SQL has no function for."""
    out, cutoffs = set(), {"facility": 0.6, "sign": 0.6, "yesno": 0.5}
    for raw in WRITTEN:
        s = " ".join((raw or "").split())
        for name in ("clinical", "occupation", "region", "facility", "sign", "yesno"):
            text = s.partition(" ")[0] if name == "facility" else s
            if text:
                key = fold_text(text).strip(" .,")
                ratio = lambda b: difflib.SequenceMatcher(None, key, b).ratio()
                out.add((name, text, *_plain_snap(text, lexicon.VOCABULARIES[name], cutoffs.get(name, 0.78)), ratio("recu"), ratio("oui" if key[:1] == "o" else "non")))
    return sorted(out)


def _forms(name: str) -> str:
    return LIST(sorted({fold_text(w) for w in lexicon.VOCABULARIES[name]}))


_ON = lambda e, col: e.replace("trim(x)", f"trim({col})")
_FV = FOLD.replace("lower(x)", "lower(v)")
_ALIKE = " ".join(f"WHEN {_quote(a)} THEN {_quote(b)}" for a, b in lexicon.ALIASES.items())
PARSE_SQL = f"""WITH r(id, x) AS (VALUES {_values(enumerate(WRITTEN))}), k AS (SELECT * FROM r, (VALUES {_values(KINDS)}) d(dtype, key, lo, hi)),
a AS (SELECT *, {SQUEEZE} AS s, {FOLD} AS f FROM k),
b AS (SELECT *, CASE WHEN x IS NULL OR s = '' THEN NULL WHEN regexp_matches(s, '^[\\s\\-–—_~.]+$') THEN 'dash' WHEN trim(f, ' .') IN {LIST(X.UNKNOWN)} THEN 'unknown' WHEN trim(f, ' .') IN {LIST(X.NOT_DONE)} THEN 'not_done' END AS mark,
 CASE WHEN key = 'facility_name' THEN 'facility' WHEN dtype = 'posneg' THEN 'sign' WHEN dtype = 'yesno' THEN 'yesno' WHEN dtype <> 'str' THEN NULL WHEN key = 'profession' THEN 'occupation' WHEN key = 'region' THEN 'region' WHEN key LIKE '%examined_by' THEN NULL ELSE 'clinical' END AS vocab,
 regexp_replace(s, '\\s', '', 'g') AS tight, {_ON(REPAIR, 's')} AS dg, replace(f, ' ', '') AS g2, trim(f, ' .,') AS ft, regexp_extract(s, '^\\S+ (.+)$', 1) AS rest FROM a),
l(name, txt, word, near, received, own) AS (VALUES {_values(_likeness())}),
c AS (SELECT b.*, l.word, l.near, l.received, l.own, CASE WHEN dtype = 'date' THEN regexp_replace(tight, '^M([/.\\-])', '11\\1') ELSE tight END AS dt,
 CASE WHEN dtype = 'grams' THEN {_ON(REPAIR, _GRAM('gqa').replace(SQUEEZE, 's'))} ELSE dg END AS t FROM b LEFT JOIN l ON l.name = vocab AND l.txt = CASE WHEN vocab = 'facility' THEN split_part(s, ' ', 1) ELSE s END),
d AS (SELECT *, {_MENDED('dt')} AS dm, try_cast(translate(regexp_extract(s, {_WD}, 1), 'AΛ', '11') AS INT) AS ww, try_cast(translate(regexp_extract(s, {_WD}, 2), 'AΛ', '11') AS INT) AS wd, {NUM('t')} AS num, regexp_matches(t, '[^0-9 .,/\\-+]') AS left_over, regexp_replace(dg, '\\s', '', 'g') AS bt FROM c),
e AS (SELECT *, {_ON(REPAIR, 'dm')} AS df, CASE WHEN contains(bt, '/') THEN regexp_extract(bt, '^(\\d{{1,3}})/(\\d{{1,3}})$', ['a', 'b']) ELSE regexp_extract(bt, '^(\\d{{3}})(\\d{{2,3}})$', ['a', 'b']) END AS p2, CASE WHEN dtype = 'temp' AND num > 100 THEN num / 10 ELSE num END AS nn FROM d),
h AS (SELECT *, regexp_matches(df, '^\\d{{1,2}}[/.\\-]\\d{{1,2}}[/.\\-]\\d{{2,4}}$') AS parted, try_cast(p2.a AS INT) AS p_s, try_cast(p2.b AS INT) AS p_d FROM e),
i AS (SELECT *, CASE WHEN parted THEN regexp_extract(df, '^(\\d{{1,2}})[/.\\-](\\d{{1,2}})[/.\\-](\\d{{2,4}})$', ['d', 'm', 'y']) WHEN regexp_matches(df, '^\\d{{8}}$') THEN regexp_extract(df, '^(\\d{{2}})(\\d{{2}})(\\d{{4}})$', ['d', 'm', 'y']) END AS q, p_s < 30 AND p_d < 20 AS cm FROM h),
j AS (SELECT *, q.y::INT + CASE WHEN q.y::INT < 100 THEN 2000 ELSE 0 END AS yy, CASE WHEN cm THEN p_s * 10 ELSE p_s END AS sys, CASE WHEN cm THEN p_d * 10 ELSE p_d END AS dia,
 regexp_replace(CASE WHEN key = 'facility_name' OR word IS NULL THEN s ELSE word END, '\\bAI( [A-Z])', 'Al\\1', 'g') AS v FROM i),
m AS (SELECT *, CASE WHEN yy BETWEEN 1990 AND 2035 THEN try_cast(printf('%04d-%02d-%02d', yy, q.m::INT, q.d::INT) AS DATE) END AS day, replace(dg, ' ', '') AS year, round(ww + wd / 7.0::DOUBLE, 1) AS wk, {_FV} AS fv,
 CASE WHEN nn = floor(nn) THEN floor(nn)::BIGINT::VARCHAR ELSE rtrim(rtrim(nn::DECIMAL(30, 6)::VARCHAR, '0'), '.') END AS shown, CASE WHEN dtype IN ('float', 'kg', 'temp') THEN printf('%g', nn) ELSE CASE WHEN nn = floor(nn) THEN floor(nn)::BIGINT::VARCHAR ELSE rtrim(rtrim(nn::DECIMAL(30, 6)::VARCHAR, '0'), '.') END END AS seen FROM j),
z AS (SELECT id, dtype, key, lo, hi, CASE
 WHEN x IS NULL OR s = '' THEN {{'v': NULL, 'n': NULL, 'd': NULL, 'ok': false, 'i': '', 'm': NULL, 'w': 1.0}}
 WHEN mark = 'dash' THEN {{'v': NULL, 'n': NULL, 'd': '—', 'ok': true, 'i': '', 'm': mark, 'w': 1.0}} WHEN mark = 'unknown' THEN {{'v': NULL, 'n': NULL, 'd': '?', 'ok': true, 'i': '', 'm': mark, 'w': 1.0}} WHEN mark = 'not_done' THEN {{'v': NULL, 'n': NULL, 'd': 'NF (non fait)', 'ok': true, 'i': '', 'm': mark, 'w': 1.0}}
 WHEN key = 'facility_name' AND rest <> '' AND length(split_part(s, ' ', 1)) <= 5 AND word <> split_part(s, ' ', 1) THEN {{'v': word || ' ' || rest, 'n': NULL, 'd': word || ' ' || rest, 'ok': true, 'i': '', 'm': NULL, 'w': near}}
 WHEN dtype = 'code' THEN {{'v': replace(upper(tight), 'ẞ', 'SS'), 'n': NULL, 'd': replace(upper(tight), 'ẞ', 'SS'), 'ok': true, 'i': '', 'm': NULL, 'w': 1.0}}
 WHEN dtype = 'str' AND key <> 'facility_name' AND vocab IS NOT NULL AND regexp_matches(s, '^[\\wÀ-ÿ]?[aA4Λ][sS5]\\.?$') AND f <> 'ras' THEN {{'v': 'RAS', 'n': NULL, 'd': 'RAS', 'ok': true, 'i': '', 'm': NULL, 'w': 0.7}}
 WHEN dtype = 'str' THEN {{'v': v, 'n': NULL, 'd': v, 'ok': true, 'i': CASE WHEN key = 'facility_name' OR vocab IS NULL THEN '' WHEN (vocab = 'clinical' AND fv IN {_forms('clinical')}) OR (vocab = 'occupation' AND fv IN {_forms('occupation')}) OR (vocab = 'region' AND fv IN {_forms('region')}) THEN ''
   WHEN key = 'region' THEN 'not a known value for this field' WHEN length(regexp_replace(v, '[^A-Za-zÀ-ÿ]', '', 'g')) BETWEEN 1 AND 4 AND NOT regexp_matches(v, '\\d') THEN 'unrecognised short word' ELSE '' END, 'm': NULL, 'w': CASE WHEN key = 'facility_name' THEN 1.0 ELSE coalesce(near, 1.0) END}}
 WHEN dtype = 'date' THEN CASE WHEN day IS NULL THEN {{'v': NULL, 'n': NULL, 'd': NULL, 'ok': false, 'i': 'could not read as a date (dd/mm/yyyy)', 'm': NULL, 'w': 1.0}} ELSE {{'v': strftime(day, '%Y-%m-%d'), 'n': NULL, 'd': strftime(day, '%d/%m/%Y'), 'ok': true, 'i': '', 'm': NULL, 'w': CASE WHEN dm <> dt OR NOT parted THEN 0.9 ELSE 1.0 END}} END
 WHEN dtype = 'date_or_year' THEN CASE WHEN day IS NOT NULL THEN {{'v': strftime(day, '%Y-%m-%d'), 'n': NULL, 'd': strftime(day, '%d/%m/%Y'), 'ok': true, 'i': '', 'm': NULL, 'w': 1.0}} WHEN regexp_matches(year, '^(19|20)\\d\\d$') THEN {{'v': year, 'n': NULL, 'd': year, 'ok': true, 'i': '', 'm': NULL, 'w': 1.0}} ELSE {{'v': NULL, 'n': NULL, 'd': NULL, 'ok': false, 'i': 'could not read as a date or year', 'm': NULL, 'w': 1.0}} END
 WHEN dtype = 'bp' THEN CASE WHEN sys IS NULL THEN {{'v': NULL, 'n': NULL, 'd': NULL, 'ok': false, 'i': 'could not read as systolic/diastolic', 'm': NULL, 'w': 1.0}} ELSE {{'v': sys || '/' || dia, 'n': NULL, 'd': sys || '/' || dia, 'ok': true, 'i': CASE WHEN sys BETWEEN 60 AND 250 AND dia BETWEEN 30 AND 150 AND sys > dia THEN '' ELSE 'implausible blood pressure' END, 'm': NULL, 'w': 1.0}} END
 WHEN dtype = 'weeks' AND wd BETWEEN 0 AND 6 THEN {{'v': wk::VARCHAR, 'n': wk, 'd': ww || ' SA + ' || wd || ' j', 'ok': true, 'i': '', 'm': NULL, 'w': 1.0}}
 WHEN dtype IN {LIST(NUMERIC)} AND (num IS NULL OR left_over) THEN {{'v': NULL, 'n': NULL, 'd': NULL, 'ok': false, 'i': 'could not read a number (' || dtype || ')', 'm': NULL, 'w': 1.0}}
 WHEN dtype = 'int' THEN {{'v': floor(num)::BIGINT::VARCHAR, 'n': floor(num), 'd': floor(num)::BIGINT::VARCHAR, 'ok': true, 'i': CASE WHEN regexp_matches(t, '^\\s*\\d+\\s*$') THEN '' ELSE 'unexpected characters around the number' END, 'm': NULL, 'w': 1.0}}
 WHEN dtype IN {LIST(NUMERIC)} THEN {{'v': shown, 'n': nn, 'd': seen || CASE dtype {' '.join(f"WHEN {_quote(a)} THEN {_quote(b)}" for a, b in UNIT_SHOWN.items())} ELSE '' END, 'ok': true, 'i': '', 'm': NULL, 'w': 1.0}}
 WHEN dtype = 'posneg' THEN CASE WHEN g2 LIKE 'neg%' OR g2 = 'n' THEN {{'v': 'negative', 'n': NULL, 'd': 'Négatif', 'ok': true, 'i': '', 'm': NULL, 'w': 1.0}} WHEN regexp_matches(g2, '^(?:[mn][eiy][gsyq5][.,]?)+$') THEN {{'v': 'negative', 'n': NULL, 'd': 'Négatif', 'ok': true, 'i': '', 'm': NULL, 'w': 0.7}}
   WHEN g2 LIKE 'pos%' OR g2 LIKE '+%' OR g2 LIKE '%+' THEN {{'v': 'positive', 'n': NULL, 'd': 'Positif', 'ok': true, 'i': '', 'm': NULL, 'w': 1.0}} WHEN word = 'Neg' THEN {{'v': 'negative', 'n': NULL, 'd': 'Négatif', 'ok': true, 'i': '', 'm': NULL, 'w': near}} WHEN word = 'Pos' THEN {{'v': 'positive', 'n': NULL, 'd': 'Positif', 'ok': true, 'i': '', 'm': NULL, 'w': near}}
   ELSE {{'v': NULL, 'n': NULL, 'd': NULL, 'ok': false, 'i': 'expected Neg/Pos', 'm': NULL, 'w': 1.0}} END
 WHEN dtype = 'yesno' THEN CASE WHEN ft = 'oui' THEN {{'v': 'true', 'n': NULL, 'd': 'Oui', 'ok': true, 'i': '', 'm': NULL, 'w': 1.0}} WHEN ft = 'non' THEN {{'v': 'false', 'n': NULL, 'd': 'Non', 'ok': true, 'i': '', 'm': NULL, 'w': 1.0}} WHEN ft IN {LIST(X.YES_WORDS)} THEN {{'v': 'true', 'n': NULL, 'd': 'Oui', 'ok': true, 'i': '', 'm': NULL, 'w': 1.0}}
   WHEN ft LIKE 'rec%' THEN {{'v': 'true', 'n': NULL, 'd': 'Oui', 'ok': true, 'i': '', 'm': NULL, 'w': 0.8}} WHEN received >= 0.7 OR regexp_matches(ft, '^[rpkh][ea][cs]') THEN {{'v': 'true', 'n': NULL, 'd': 'Oui', 'ok': true, 'i': '', 'm': NULL, 'w': 0.75}} WHEN ft IN {LIST(X.NO_WORDS)} OR ft LIKE 'neg%' THEN {{'v': 'false', 'n': NULL, 'd': 'Non', 'ok': true, 'i': '', 'm': NULL, 'w': 1.0}}
   WHEN length(ft) <= 4 AND ft LIKE 'n%' THEN {{'v': 'false', 'n': NULL, 'd': 'Non', 'ok': true, 'i': '', 'm': NULL, 'w': own}} WHEN length(ft) <= 4 AND ft LIKE 'o%' THEN {{'v': 'true', 'n': NULL, 'd': 'Oui', 'ok': true, 'i': '', 'm': NULL, 'w': own}} WHEN word = 'Oui' THEN {{'v': 'true', 'n': NULL, 'd': 'Oui', 'ok': true, 'i': '', 'm': NULL, 'w': near}}
   WHEN word = 'Non' THEN {{'v': 'false', 'n': NULL, 'd': 'Non', 'ok': true, 'i': '', 'm': NULL, 'w': near}} ELSE {{'v': NULL, 'n': NULL, 'd': NULL, 'ok': false, 'i': 'expected Oui/Non', 'm': NULL, 'w': 1.0}} END
 WHEN dtype = 'sex' THEN CASE WHEN trim(f, ' .') IN ('f', 'feminin', 'fille') THEN {{'v': 'F', 'n': NULL, 'd': 'F', 'ok': true, 'i': '', 'm': NULL, 'w': 1.0}} WHEN trim(f, ' .') IN ('m', 'masculin', 'garcon', 'h') THEN {{'v': 'M', 'n': NULL, 'd': 'M', 'ok': true, 'i': '', 'm': NULL, 'w': 1.0}} ELSE {{'v': NULL, 'n': NULL, 'd': NULL, 'ok': false, 'i': 'expected F/M', 'm': NULL, 'w': 1.0}} END
 ELSE {{'v': s, 'n': NULL, 'd': s, 'ok': true, 'i': '', 'm': NULL, 'w': 1.0}} END::STRUCT(v VARCHAR, n DOUBLE, d VARCHAR, ok BOOLEAN, i VARCHAR, m VARCHAR, w DOUBLE) AS p FROM m),
y AS (SELECT id, dtype, key, p, CASE WHEN p.ok AND (p.n < lo OR p.n > hi) THEN 'out of plausible range (' || printf('%g', lo) || '–' || printf('%g', hi) || ')' END AS far FROM z)"""
PARSED_COLUMNS = "id, dtype, key, p.v AS value, p.n AS n, p.d AS display, p.ok AS ok, concat_ws('; ', nullif(p.i, ''), far) AS issues, p.m AS marker, round(p.w, 6) AS snapped"


def _written(spark) -> DataFrame:
    rows = [(i, r, *k) for i, r in enumerate(WRITTEN) for k in KINDS]
    return spark.createDataFrame(rows, "id bigint, raw string, dtype string, key string, lo double, hi double")


@query("parse_all", f"{PARSE_SQL} SELECT {PARSED_COLUMNS} FROM y")
def parse_all(spark, sf_dir):
    p = parse(_written(spark))
    return p.select("id", "dtype", "key", "parsed.value", "parsed.n", "parsed.display", "parsed.ok", F.array_join("parsed.issues", "; ").alias("issues"), "parsed.marker", F.round("parsed.snapped", 6).alias("snapped"))


# ---- answers

ANSWERS = [
    (i, kind, dtype, key, lo, hi, x)
    for i, (kind, dtype, key, lo, hi, x) in enumerate(
        [("check", "bool", "high_risk", None, None, x) for x in ("Oui", " x ", "☐", "non", "peut-être", "?", "", None)] + [("radio", "enum", "facility_type", None, None, x) for x in ("csc", "DR", "autre", "NSP", None)]
        + [("text", d, k, lo, hi, x) for d, k, lo, hi in KINDS for x in ("12", "120/80", "12/03/2024", "3,5", "37.2", "-", "inconnu", "NF", "abc", "oui", "neg", "F", "  deux  mots ", "", None)] + [(None, None, None, None, None, x) for x in (" rien ", "?", None)]
    )
]
CHOICES = ["DR", "CSC", "CSU"]
#: What the form's rules make of some answers: status, value, display (null status: refused).
JUDGED = {
    ("check", "Oui"): ("KNOWN", "true", "☑"), ("check", " x "): ("KNOWN", "true", "☑"), ("check", "☐"): ("KNOWN", "false", "☐"), ("check", "non"): ("KNOWN", "false", "☐"), ("check", "?"): ("UNKNOWN", None, "?"),
    ("radio", "csc"): ("KNOWN", "CSC", "CSC"), ("radio", "DR"): ("KNOWN", "DR", "DR"), ("radio", "NSP"): ("UNKNOWN", None, "?"), (None, " rien "): ("KNOWN", "rien", "rien"), (None, "?"): ("UNKNOWN", None, "?"),
    ("str", "-"): ("NOT_APPLICABLE", None, "—"), ("str", "NF"): ("NOT_APPLICABLE", None, "NF (non fait)"), ("str", "inconnu"): ("UNKNOWN", None, "?"), ("bp", "120/80"): ("KNOWN", "120/80", "120/80"), ("bp", "NF"): ("NOT_APPLICABLE", None, "NF (non fait)"),
    ("int", "12"): ("KNOWN", "12", "12"), ("kg", "3,5"): ("KNOWN", "3.5", "3.5 kg"), ("temp", "37.2"): ("KNOWN", "37.2", "37.2 °C"), ("float", "3,5"): ("KNOWN", "3.5", "3.5"), ("cm", "12"): ("KNOWN", "12", "12 cm"), ("days", "12"): ("KNOWN", "12", "12 j"),
    ("date", "12/03/2024"): ("KNOWN", "2024-03-12", "12/03/2024"), ("yesno", "oui"): ("KNOWN", "true", "Oui"), ("posneg", "neg"): ("KNOWN", "negative", "Négatif"), ("sex", "F"): ("KNOWN", "F", "F"), ("weeks", "12"): ("KNOWN", "12", "12 SA"),
    ("check", "peut-être"): (None, None, None), ("radio", "autre"): (None, None, None), ("int", "abc"): (None, None, None), ("bp", "12"): (None, None, None), ("date", "abc"): (None, None, None), ("sex", "oui"): (None, None, None), ("str", ""): (None, None, None), ("check", None): (None, None, None),
}


def _judged_keys():
    return [(i, *JUDGED[k]) for i, kind, dtype, _, _, _, x in ANSWERS if (k := (dtype if kind == "text" else kind, x)) in JUDGED and (kind != "text" or dtype != "str" or True)]


@query("typed_answer", f"SELECT * FROM (VALUES {_values(_judged_keys())}) v(id, status, value, display)")
def typed_answer(spark, sf_dir):
    """Answers of every type; the SQL lists what the form's rules say of those in JUDGED."""
    rows = spark.createDataFrame(ANSWERS, "id bigint, kind string, dtype string, key string, lo double, hi double, text string").withColumn("options", F.array(*map(F.lit, CHOICES)))
    wanted = spark.createDataFrame([(k[0],) for k in _judged_keys()], "id bigint")
    return answers.typed_answers(rows).join(wanted, "id", "left_semi").select("id", "answer.status", "answer.value", "answer.display")


_FIELDS = """SELECT l_orderkey AS page, 'f' || l_linenumber AS key, l_linenumber AS ord, 'int' AS dtype, l_quantity::BIGINT::VARCHAR AS value, CASE WHEN l_discount < 0.03 THEN 'NEEDS_REVIEW' WHEN l_tax > 0.06 THEN 'ILLEGIBLE' ELSE 'KNOWN' END AS status, l_discount * 10 AS confidence,
 l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_discount, l_tax) AS n FROM lineitem"""


def _fields(spark, sf_dir) -> DataFrame:
    """Fields of pages: order lines, one for each page and key."""
    l = lambda c: F.col(f"l_{c}")  # noqa: E731, E741
    status = F.when(l("discount") < 0.03, "NEEDS_REVIEW").when(l("tax") > 0.06, "ILLEGIBLE").otherwise("KNOWN")
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax")
    value = l("quantity").cast("bigint").cast("string")
    rows = table(spark, sf_dir, "lineitem").withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return rows.select(
        l("orderkey").alias("page"), F.concat(F.lit("f"), l("linenumber")).alias("key"), l("linenumber").alias("ord"), F.lit("text").alias("kind"), F.lit("int").alias("dtype"), F.lit(0.0).alias("lo"), F.lit(40.0).alias("hi"), F.array().cast("array<string>").alias("options"),
        value.alias("value"), value.alias("display"), value.alias("raw"), status.alias("status"), (l("discount") * 10).alias("confidence"), F.array(F.lit("confirm it"), F.lit("odd")).alias("issues"), l("suppkey").alias("suppkey"), F.lit("lines").alias("page_type"))


@query("answers_applied", f"""WITH f AS (SELECT * FROM ({_FIELDS}) WHERE n = 1), a AS (SELECT page, key, value, status, confidence, CASE WHEN l_suppkey % 3 > 0 THEN NULL WHEN l_suppkey % 4 = 0 THEN 'confirm' WHEN l_suppkey % 4 = 1 THEN 'status' ELSE 'text' END AS how,
 CASE WHEN page % 5 = 0 AND l_suppkey % 12 = 6 THEN 'abc' ELSE '4l' END AS typed FROM f), b AS (SELECT DISTINCT page FROM a WHERE how = 'text' AND typed = 'abc'),
c AS (SELECT a.*, how IS NOT NULL AND b.page IS NULL AS hit FROM a LEFT JOIN b ON b.page = a.page)
SELECT page, key, CASE WHEN NOT hit OR how = 'confirm' THEN value WHEN how = 'text' THEN '41' END AS value, CASE WHEN NOT hit OR how = 'confirm' THEN value WHEN how = 'status' THEN '—' ELSE '41' END AS display, CASE WHEN hit AND how = 'text' THEN typed ELSE value END AS raw,
 CASE WHEN NOT hit THEN status WHEN how = 'status' THEN 'NOT_APPLICABLE' ELSE 'KNOWN' END AS status, CASE WHEN hit THEN 1 ELSE round(confidence, 6) END::DOUBLE AS confidence,
 CASE WHEN NOT hit THEN 'confirm it;odd' WHEN how = 'confirm' THEN 'odd;confirmed by midwife' WHEN how = 'status' THEN 'set by midwife' ELSE 'entered by midwife;out of plausible range (0–40)' END AS issues, hit AS corrected FROM c""")
def answers_applied(spark, sf_dir):
    """Answers to a third of all fields; pages with one refused answer keep their fields."""
    fields = _fields(spark, sf_dir)
    how = F.when(F.col("suppkey") % 4 == 0, "confirm").when(F.col("suppkey") % 4 == 1, "status").otherwise("text")
    given = fields.where("suppkey % 3 = 0").withColumn("how", how)
    typed = F.when((F.col("page") % 5 == 0) & (F.col("suppkey") % 12 == 6), "abc").otherwise("4l")
    asked = given.select("page", "key", (F.col("how") == "confirm").alias("confirm"), F.when(F.col("how") == "text", typed).alias("text"), F.when(F.col("how") == "status", "NOT_APPLICABLE").alias("new_status"))
    after, _ = answers.apply_answers(fields, asked)
    return after.select("page", "key", "value", "display", "raw", "status", F.round("confidence", 6).alias("confidence"), F.array_join("issues", ";").alias("issues"), "corrected")


@query("answers_refused", f"SELECT DISTINCT page, key, CASE WHEN page % 2 = 0 THEN 'unknown field' WHEN n % 2 = 0 THEN 'could not read a number (int)' ELSE 'empty answer' END AS reason FROM (SELECT page, CASE WHEN page % 2 = 0 THEN 'zz' ELSE key END AS key, ord AS n FROM ({_FIELDS}) WHERE n = 1 AND ord <= 2 AND page % 7 = 0)")
def answers_refused(spark, sf_dir):
    fields = _fields(spark, sf_dir)
    some = fields.where("ord <= 2 AND page % 7 = 0")
    asked = some.select("page", F.when(F.col("page") % 2 == 0, "zz").otherwise(F.col("key")).alias("key"), F.lit(None).cast("boolean").alias("confirm"), F.when(F.col("ord") % 2 == 0, "abc").otherwise("  ").alias("text"), F.lit(None).cast("string").alias("new_status"))
    return answers.judged_answers(fields, asked).select("page", "key", "reason")


# ---- catalog and views

def _catalog_rows():
    return [(page, n, *f[:7], "|".join(f[7] or [])) for page, text in catalog.PAGES.items() for n, f in enumerate(catalog.page_fields(text))]


@query("catalog_counts", "SELECT * FROM (VALUES ('cover', 16, 5, 9, 2, 0, 1, 1), ('identification', 78, 10, 9, 0, 59, 4, 0), ('current_pregnancy', 276, 4, 0, 2, 270, 0, 0), ('delivery', 26, 10, 12, 4, 0, 1, 0), ('postpartum_early_mother', 43, 11, 26, 6, 0, 0, 0), ('postpartum_early_newborn', 41, 13, 26, 2, 0, 0, 0), ('postpartum_late_mother', 43, 11, 26, 6, 0, 0, 0), ('postpartum_late_newborn', 41, 13, 26, 2, 0, 0, 0)) v(page_type, fields, texts, checks, radios, cells, pii, linking)")
def catalog_counts(spark, sf_dir):
    """Fields of each page by kind, without identifiers; the counts are the published form's."""
    own = ~F.col("pii")
    n = lambda kind: F.count_if(own & (F.col("kind") == kind))
    return catalog.fields(spark, pii=True).groupBy("page_type").agg(F.count_if(own).alias("fields"), n("text").alias("texts"), n("check").alias("checks"), n("radio").alias("radios"), n("cell").alias("cells"), F.count_if("pii").alias("pii"), F.count_if("linking").alias("linking"))


@query("catalog_repeats", "SELECT NULL::VARCHAR AS page_type, NULL::VARCHAR AS key, NULL::BIGINT AS n WHERE false")
def catalog_repeats(spark, sf_dir):
    return records.repeated_keys(catalog.fields(spark, pii=True), "page_type", "key")


@query("empty_form", "SELECT 'cover' AS page_type, 'high_risk' AS key, 'check' AS kind, 'bool' AS dtype, 'NOT_PROVIDED' AS status, 0.0::DOUBLE AS confidence")
def empty_form(spark, sf_dir):
    form = catalog.empty_form(catalog.fields(spark), "cover")
    return form.where("key = 'high_risk'").select("page_type", "key", "kind", "dtype", "status", "confidence")


@query("questions", "SELECT * FROM (VALUES ('facility_type', 'Quelle option est cochée pour « Type » ?', 'Which option is ticked for “Type”?'), ('high_risk', 'La case « high_risk » est-elle cochée ?', 'Is the box “high_risk” ticked?'), ('region', 'Quelle est la valeur de « Région » ?', 'What is the value of “Region”?')) v(key, question_fr, question_en)")
def questions(spark, sf_dir):
    labels = spark.createDataFrame([("cover", "facility_type", "Type", "Type"), ("cover", "region", "Région", "Region")], "page_type string, key string, label_fr string, label_en string")
    rows = catalog.labelled(catalog.fields(spark).where("page_type = 'cover'"), labels)
    return rows.where("key IN ('facility_type', 'high_risk', 'region')").select("key", "question_fr", "question_en")


_KEYS = ["visits.m9.blood_pressure", "previous_delivery.2.mode", "blood_pressure", "risk.anemia", "obstetric_anomalies.count.abortion", "family_history.woman_family.allergies", "woman_history.medical.hypertension", "region", "education_level", "profession", "husband_profession", "facility_name", "record_number", "seen_by", "visits.m9.examined_by", "visits.m7.platelets", "decision"]


@query("key_routing", f"""SELECT key, CASE WHEN regexp_matches(key, '^(visits|previous_delivery|obstetric_anomalies|family_history|woman_history)\\.') THEN string_split(key, '.')[-1] ELSE key END AS prior_column,
 CASE WHEN key IN ('region', 'province') THEN key WHEN key = 'education_level' THEN 'education' WHEN key IN ('profession', 'husband_profession') THEN 'occupation' WHEN key IN ('facility_name', 'record_number') OR key LIKE '%examined_by' OR key LIKE '%seen_by' OR key LIKE '%platelets%' THEN NULL ELSE 'clinical' END AS vocabulary FROM (VALUES {_values((k,) for k in _KEYS)}) v(key)""")
def key_routing(spark, sf_dir):
    k = F.col("key")
    return spark.createDataFrame([(x,) for x in _KEYS], "key string").select("key", catalog.prior_column(k).alias("prior_column"), lexicon.vocabulary(k).alias("vocabulary"))


def _records(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("record_id"), F.col("o_orderstatus").alias("state"), F.col("o_orderdate").alias("captured_at"), F.col("o_orderpriority").alias("page_type")), o.where("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("code"), F.col("o_orderdate").alias("linked_at"))


@query("record_view", f"""WITH f AS (SELECT * FROM ({_FIELDS}) WHERE n = 1), g AS (SELECT page, string_agg(key, ',' ORDER BY confidence, ord) FILTER (WHERE status IN ('NEEDS_REVIEW', 'ILLEGIBLE')) AS ask, string_agg(key, ',' ORDER BY ord) FILTER (WHERE ord <> 3 AND status <> 'ILLEGIBLE') AS filled, count(*) FILTER (WHERE status = 'KNOWN') AS known, count(*) AS n, arg_min(value, ord) AS first FROM f GROUP BY page)
SELECT o_orderkey AS record_id, o_orderstatus AS state, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END AS patient_code, g.page IS NOT NULL AS extracted, coalesce(ask, '') AS needs_review, coalesce(filled, '') AS filled, known::BIGINT AS known, n::INT AS fields, first FROM orders LEFT JOIN g ON page = o_orderkey""")
def record_view(spark, sf_dir):
    rows, links = _records(spark, sf_dir)
    fields = _fields(spark, sf_dir).withColumn("status", F.col("status")).withColumn("display", F.when(F.col("ord") == 3, "☐").when(F.col("status") == "ILLEGIBLE", None).otherwise(F.col("display")))
    log = rows.select("record_id", F.lit(1).alias("seq"), F.lit(None).cast("string").alias("old_state"), F.col("state").alias("new_state"))
    v = records.record_view(rows, fields, links, log)
    keys = lambda c: F.coalesce(F.array_join(F.transform(c, lambda f: f["key"]), ","), F.lit(""))
    known = F.when(F.col("extracted"), F.coalesce(F.try_element_at("summary", F.lit("KNOWN")), F.lit(0)))
    return v.select("record_id", "state", "patient_code", "extracted", keys("needs_review").alias("needs_review"), keys("filled").alias("filled"), known.cast("bigint").alias("known"), F.when(F.col("extracted"), F.size("fields")).alias("fields"), F.get("fields", F.lit(0))["value"].alias("first"))


@query("fields_with_catalog", f"SELECT page, key, 'int' AS dtype, CASE ord WHEN 1 THEN 'Line one' END AS label FROM ({_FIELDS}) WHERE n = 1")
def fields_with_catalog(spark, sf_dir):
    defined = spark.createDataFrame([("lines", "f1", "Line one")], "page_type string, key string, label string")
    return records.with_catalog(_fields(spark, sf_dir), defined).select("page", "key", "dtype", "label")


@query("links_in_order", "SELECT o_custkey AS code, o_orderkey AS record_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INT AS place FROM orders WHERE o_orderkey % 3 > 0")
def links_in_order(spark, sf_dir):
    return records.links_of(_records(spark, sf_dir)[1]).select("code", "record_id", "place")


@query("patient_records", "SELECT c_custkey AS code, count(o_orderkey)::BIGINT AS visits, max(o_orderdate) AS last_visit, coalesce(string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderdate, o_orderkey), '') AS records FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 3 > 0) ON o_custkey = c_custkey GROUP BY 1")
def patient_records(spark, sf_dir):
    rows, links = _records(spark, sf_dir)
    v = records.patient_records(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("code")), links.drop("linked_at"), rows)
    listed = F.coalesce(F.array_join(F.transform("records", lambda r: F.concat_ws(":", r["record_id"], r["state"])), ","), F.lit(""))
    return v.select("code", "visits", "last_visit", listed.alias("records"))


_CODE = "'P' || lpad(c_custkey::VARCHAR, 6, '0')"


@query("patient_search_near", f"""WITH p AS (SELECT {_CODE} AS code, c_custkey FROM customer), q AS (SELECT DISTINCT code FROM p WHERE c_custkey % 50 = 0), l AS (SELECT {_CODE.replace('c_custkey', 'o_custkey')} AS code, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 3 > 0),
s AS (SELECT code, count(*) AS visits, max(o_orderdate) AS last_visit, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS pages FROM l GROUP BY 1), m AS (SELECT q.code, p.code AS candidate, damerau_levenshtein(q.code, p.code)::INT AS distance FROM q JOIN p ON damerau_levenshtein(q.code, p.code) <= 1)
SELECT m.code, candidate, distance, row_number() OVER (PARTITION BY m.code ORDER BY distance, candidate)::INT AS place, coalesce(visits, 0)::BIGINT AS visits, last_visit, coalesce(pages, '') AS pages FROM m LEFT JOIN s ON s.code = candidate""")
def patient_search_near(spark, sf_dir):
    """Patients within one edit of the codes asked for, every fiftieth customer's."""
    coded = lambda c: F.concat(F.lit("P"), F.lpad(c.cast("string"), 6, "0"))
    rows, links = _records(spark, sf_dir)
    patients = table(spark, sf_dir, "customer").select(coded(F.col("c_custkey")).alias("code"), "c_custkey")
    own = links.select("record_id", coded(F.col("code")).alias("code"))
    return records.search_patients(patients.where("c_custkey % 50 = 0").select("code"), patients.select("code"), own, rows)


@query("link_outcomes", f"""WITH p AS (SELECT {_CODE} AS code FROM customer WHERE c_custkey % 3 > 0), r AS (SELECT o_orderkey AS record, CASE WHEN o_orderkey % 4 = 0 THEN 'TO_REVIEW' ELSE 'VALIDATED' END AS state, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE {_CODE.replace('c_custkey', 'o_custkey')} END AS code, o_orderkey % 5 = 0 AS cr FROM orders),
d AS (SELECT DISTINCT code FROM r WHERE code <> ''), n AS (SELECT d.code, string_agg(p.code, ',' ORDER BY p.code) AS near FROM d JOIN p ON damerau_levenshtein(d.code, p.code) = 1 GROUP BY 1)
SELECT record, r.code, CASE WHEN state <> 'VALIDATED' THEN 'not_validated' WHEN r.code = '' THEN CASE WHEN cr THEN 'created' ELSE 'no_code' END WHEN p.code IS NOT NULL THEN 'linked' WHEN cr THEN 'created' ELSE 'unknown_code' END AS outcome,
 CASE WHEN state = 'VALIDATED' AND r.code <> '' AND p.code IS NULL AND NOT cr THEN coalesce(near, '') END AS candidates FROM r LEFT JOIN p ON p.code = r.code LEFT JOIN n ON n.code = r.code""")
def link_outcomes(spark, sf_dir):
    coded = lambda c: F.concat(F.lit("p "), F.lpad(c.cast("string"), 6, "0"))
    patients = table(spark, sf_dir, "customer").where("c_custkey % 3 > 0").select(F.upper(F.replace(coded(F.col("c_custkey")), F.lit(" "), F.lit(""))).alias("code"))
    o = F.col("o_orderkey")
    asked = table(spark, sf_dir, "orders").select(o.alias("record"), F.when(o % 4 == 0, "TO_REVIEW").otherwise("VALIDATED").alias("state"), F.when(o % 11 == 0, "").otherwise(coded(F.col("o_custkey"))).alias("code"), (o % 5 == 0).alias("create"))
    return control.link_outcomes(asked, patients).withColumn("candidates", F.array_join("candidates", ","))


# ---- booklet decisions over order lines standing in for fields

@query("booklet_radio", """WITH o AS (SELECT l_orderkey AS page, l_linenumber AS option, CASE WHEN l_suppkey % 4 > 0 THEN l_tax * 2 END AS score FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_discount, l_tax) AS n FROM lineitem) WHERE n = 1),
g AS (SELECT page, count(*) FILTER (WHERE score >= 0.12) AS n, count(score) AS seen, arg_max(option, {'a': score, 'b': option}) FILTER (WHERE score >= 0.12) AS best, string_agg(option, ', ' ORDER BY option) FILTER (WHERE score >= 0.12) AS names, string_agg(option, ', ' ORDER BY option) FILTER (WHERE score IS NULL) AS gone FROM o GROUP BY 1)
SELECT page, best AS value, CASE WHEN seen = 0 OR n > 1 OR gone IS NOT NULL THEN 'NEEDS_REVIEW' WHEN n = 1 THEN 'KNOWN' ELSE 'NOT_PROVIDED' END AS status, CASE WHEN seen = 0 THEN 0.3 WHEN n > 1 THEN 0.5 WHEN n = 1 THEN CASE WHEN gone IS NULL THEN 0.9 ELSE 0.6 END WHEN gone IS NULL THEN 0.85 ELSE 0.5 END::DOUBLE AS confidence,
 CASE WHEN seen = 0 THEN 'checkboxes not found on the photo' WHEN n > 1 THEN 'several boxes ticked: ' || names WHEN gone IS NOT NULL THEN 'boxes not found: ' || gone END AS issue FROM g""")
def booklet_radio(spark, sf_dir):
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax")
    rows = table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(w)).where("n = 1")
    return decide.booklet_radio_decision(rows.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("option"), F.when(F.col("l_suppkey") % 4 > 0, F.col("l_tax") * 2).alias("score")), ["page"])


_BOOK = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey % 4 > 0 AS inked, l_partkey % 13 AS k, l_tax * 10 + 0.3 AS conf, l_quantity::INT % 2 AS agreement FROM lineitem"


@query("booklet_text", f"""WITH r AS ({_BOOK}), d AS (SELECT *, CASE WHEN k = 0 THEN 0 WHEN NOT inked AND k <> 12 AND k = 1 THEN 1 WHEN NOT inked AND k <> 12 THEN 2 WHEN k = 2 THEN 3 WHEN k = 1 THEN 1 WHEN k = 3 THEN 4 WHEN k = 4 THEN 5 WHEN k = 5 THEN 6 WHEN k = 6 THEN 7 WHEN k = 7 THEN 8 WHEN k = 8 THEN 9 WHEN conf < 0.88 THEN 10 ELSE 11 END AS rung FROM r)
SELECT l_orderkey, l_linenumber, l_partkey, ['NOT_PROVIDED', 'NEEDS_REVIEW', 'NOT_PROVIDED', 'NOT_APPLICABLE', 'ILLEGIBLE', 'NOT_APPLICABLE', 'NOT_APPLICABLE', 'UNKNOWN', 'NEEDS_REVIEW', 'NEEDS_REVIEW', 'NEEDS_REVIEW', 'KNOWN'][rung + 1] AS status,
 round(CASE rung WHEN 0 THEN 0.6 WHEN 1 THEN 0.55 WHEN 2 THEN 0.9 WHEN 3 THEN 0.85 WHEN 4 THEN 0.25 WHEN 5 THEN 0.85 WHEN 6 THEN least(0.9, conf) WHEN 8 THEN least(conf, 0.45) WHEN 9 THEN least(conf, 0.5) ELSE least(1, conf) END, 6)::DOUBLE AS confidence,
 CASE rung WHEN 1 THEN 'written across several rows: confirm it applies to this row' WHEN 4 THEN 'handwriting could not be read' WHEN 8 THEN 'could not interpret the handwriting' WHEN 9 THEN 'odd' WHEN 10 THEN CASE agreement WHEN 0 THEN 'the two OCR readings disagree' ELSE 'low reading confidence' END ELSE '' END AS issues, rung = 1 AS from_span FROM d""")
def booklet_text(spark, sf_dir):
    from casebook.functions.parse import PARSED

    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey % 4 > 0 AS inked", "l_partkey % 13 AS k", "l_tax * 10 + 0.3D AS conf", "int(l_quantity) % 2 AS agreement")
    k, none = F.col("k"), F.lit(None).cast("string")
    marker = F.when(k == 4, "dash").when(k == 5, "not_done").when(k == 6, "unknown")
    issues = F.when(k == 8, F.array(F.lit("odd"))).otherwise(F.array().cast("array<string>"))
    parsed = F.when(~k.isin(1, 3), F.struct(F.lit("x").alias("value"), F.lit(None).cast("double").alias("n"), F.lit("x").alias("display"), (k != 7).alias("ok"), issues.alias("issues"), marker.alias("marker"), F.lit(1.0).alias("snapped")).cast(PARSED))
    read = F.when(k == 0, "/ /").otherwise("mot")
    r = {"kind": F.lit("text"), "inked": F.col("inked"), "fraction": F.lit(0.0), "dash": k == 2, "small": read, "medium": read, "small_clean": F.when(k == 0, "").otherwise("mot"), "medium_clean": F.when(k == 0, "").otherwise("mot"), "line": F.when(k == 12, "mot").otherwise(none),
         "span": F.when(k == 1, "RAS"), "span_score": F.lit(0.55), "parsed": parsed, "conf": F.col("conf"), "agreement": F.col("agreement"), "threshold": F.lit(decide.KNOWN_PHOTO)}
    d = rows.withColumn("d", decide.booklet_text_decision(r))
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "d.status", F.round("d.confidence", 6).alias("confidence"), F.array_join("d.issues", ",").alias("issues"), "d.from_span")


RINGS = [(1, "g", "A", 9.0), (1, "r", "Rh(+)", 0.0), (2, "g", "8", 1.3), (2, "r", "sus -", 1.0), (3, "g", "zz", 30.0), (4, "g", "0", 0.0), (4, "g", "AB", 0.0), (5, "r", "?", 9.2)]
CIRCLED = [(i, k) for i in range(1, 7) for k in ("g", "r")]


@query("circled_options", "SELECT page, key, value, status, confidence::DOUBLE AS confidence FROM (VALUES (1, 'g', 'A', 'NEEDS_REVIEW', 0.75), (1, 'r', 'positive', 'NEEDS_REVIEW', 0.75), (2, 'g', 'B', 'NEEDS_REVIEW', 0.75), (2, 'r', 'negative', 'NEEDS_REVIEW', 0.75), (3, 'g', NULL, 'NEEDS_REVIEW', 0.5), (3, 'r', NULL, 'NOT_PROVIDED', 0.5), (4, 'g', 'AB', 'NEEDS_REVIEW', 0.4), (4, 'r', NULL, 'NOT_PROVIDED', 0.5), (5, 'g', NULL, 'NOT_PROVIDED', 0.5), (5, 'r', 'positive', 'NEEDS_REVIEW', 0.75), (6, 'g', NULL, 'NOT_PROVIDED', 0.5), (6, 'r', NULL, 'NOT_PROVIDED', 0.5)) v(page, key, value, status, confidence)")
def circled_options(spark, sf_dir):
    options = F.when(F.col("key") == "g", F.array(*map(F.lit, ["A", "B", "O", "AB"]))).otherwise(F.array(F.lit("negative"), F.lit("positive")))
    fields = spark.createDataFrame(CIRCLED, "page int, key string").withColumn("options", options)
    return decide.circled_decision(spark.createDataFrame(RINGS, "page int, key string, text string, offset double"), fields)


@query("span_rows", "SELECT l_orderkey AS page, 'k' || k AS key, 'NEEDS_REVIEW' AS status, round(least(0.6, l_tax * 10), 6)::DOUBLE AS confidence FROM (SELECT *, unnest(range(0, 1 + l_suppkey % 3)) AS k FROM lineitem WHERE l_linenumber = 1)")
def span_rows(spark, sf_dir):
    keys = F.transform(F.sequence(F.lit(0), F.col("l_suppkey") % 3), lambda i: F.concat(F.lit("k"), i))
    spans = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("page"), keys.alias("keys"), F.lit("RAS").alias("text"), (F.col("l_tax") * 10).alias("score"))
    return decide.span_results(spans).select("page", "key", "status", F.round("confidence", 6).alias("confidence"))


@query("fallback_reading", """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_partkey % 4 AS k, -l_quantity::DOUBLE / 2 AS fit, l_discount * 10 AS conf, l_suppkey % 5 > 0 AS decoded_ok FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN k > 0 AND fit >= -12 AND decoded_ok AND k < 3 THEN 'decoded' ELSE 'free' END AS text, round(CASE WHEN k > 0 AND fit >= -12 AND decoded_ok AND k < 3 THEN least(conf, 0.75) ELSE 0.5 END, 6)::DOUBLE AS score FROM r""")
def fallback_reading(spark, sf_dir):
    from casebook.functions.parse import PARSED

    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_partkey % 4 AS k", "-l_quantity / 2 AS fit", "l_discount * 10 AS conf", "l_suppkey % 5 > 0 AS decoded_ok")
    k = F.col("k")
    make = lambda ok, issue: F.struct(F.lit("x").alias("value"), F.lit(None).cast("double").alias("n"), F.lit("x").alias("display"), ok.alias("ok"), F.when(issue, F.array(F.lit("odd"))).otherwise(F.array().cast("array<string>")).alias("issues"), F.lit(None).cast("string").alias("marker"), F.lit(1.0).alias("snapped")).cast(PARSED)
    r = decide.fallback_reading(make(k != 1, k == 2), F.when(k < 3, "decoded"), make(F.col("decoded_ok"), F.lit(False)), F.col("fit"), F.col("conf"), F.lit("free"), F.lit(0.5))
    return rows.withColumn("r", r).select("l_orderkey", "l_linenumber", "l_partkey", "r.text", F.round("r.score", 6).alias("score"))


# ---- evaluation against truth

TRUTHS = [  # id, kind, dtype, key, status, raw, glyph missing, value, predicted status, value, n, display, raw
    (1, "check", "bool", "x", "KNOWN", None, False, "true", "KNOWN", "true", None, "☒", None), (2, "check", "bool", "x", "KNOWN", None, False, "true", "KNOWN", "false", None, "☐", None), (3, "radio", "enum", "x", "NOT_PROVIDED", None, False, None, "NOT_PROVIDED", None, None, None, None),
    (4, "text", "kg", "w", "KNOWN", "62,5 kg", False, None, "KNOWN", "62.5", 62.5, "62.5 kg", "62.5"), (5, "text", "kg", "w", "KNOWN", "62,5 kg", False, None, "KNOWN", "63", 63.0, "63 kg", "63"), (6, "text", "str", "seen_by", "KNOWN", "Dr. El-Amrani", False, None, "KNOWN", "dr el amrani", None, None, None),
    (7, "text", "str", "seen_by", "KNOWN", "F�s", True, None, "KNOWN", "Fès", None, None, None), (8, "text", "str", "seen_by", "NOT_APPLICABLE", "—", True, None, "NOT_PROVIDED", None, None, None, None), (9, "text", "str", "seen_by", "NOT_PROVIDED", None, False, None, "KNOWN", "x", None, "x", "x"),
    (10, "cell", "date", "d", "KNOWN", "12/03/2024", False, None, "KNOWN", "2024-03-12", None, "12/03/2024", "12/3/24"), (11, "cell", "bp", "b", "KNOWN", "12/8", False, None, "NEEDS_REVIEW", "120/80", None, "120/80", "120/80"), (12, "cell", "yesno", "y", "KNOWN", "oui", False, None, "KNOWN", "false", None, "Non", "nan"),
    (13, "text", "int", "a", "KNOWN", "illisible", False, None, "ILLEGIBLE", None, None, None, "illisible"), (14, "text", "int", "a", "KNOWN", "31", False, None, "MISSING", None, None, None, None),
]
VERDICTS = [(1, True, True), (2, False, True), (3, True, True), (4, True, True), (5, False, True), (6, True, True), (7, True, True), (8, True, True), (9, True, False), (10, True, True), (11, True, False), (12, False, True), (13, True, False), (14, False, False)]


@query("value_verdicts", f"SELECT * FROM (VALUES {_values(VERDICTS)}) v(id, value_ok, status_ok)")
def value_verdicts(spark, sf_dir):
    """Typed comparison of truth and prediction; the SQL lists what the rules of evaluation say of each case."""
    rows = spark.createDataFrame(TRUTHS, "id bigint, kind string, dtype string, key string, g_status string, raw string, gap boolean, g_value string, status string, value string, n double, display string, p_raw string").withColumns({"lo": F.lit(None).cast("double"), "hi": F.lit(None).cast("double")})
    p = parse(rows)
    g = {"kind": F.col("kind"), "dtype": F.col("dtype"), "status": F.col("g_status"), "raw": F.col("raw"), "value": F.col("g_value"), "glyph_missing": F.col("gap"), "parsed": F.col("parsed")}
    got = {"value": F.col("value"), "n": F.col("n"), "display": F.col("display"), "raw": F.col("p_raw")}
    return p.select("id", evaluate.value_correct(g, got).alias("value_ok"), evaluate.status_correct(F.col("g_status"), F.col("status"), F.col("gap")).alias("status_ok"))


REAL_TRUTH = [  # photo, key, value, accept, alt, status, span
    ("a", "k1", "12", None, None, None, None), ("a", "k2", "x", ["y"], ["k9"], None, None), ("a", "k3", "z", None, ["k8"], None, None), ("a", "k4", None, None, None, "NOT_PROVIDED", None), ("a", "k5", None, None, None, "NOT_PROVIDED", None), ("a", "s1", None, None, None, None, "RAS"), ("a", "s2", None, None, None, None, "RAS"), ("a", "s3", None, None, None, None, "RAS"),
    ("b", "k1", "1", ["l"], None, None, None), ("b", "k2", "2", None, ["k1", "k7"], None, None), ("b", "k6", "5,0", None, None, None, None), ("b", "k0", "q", None, None, None, None), ("b", "st", "v", None, None, "NEEDS_REVIEW", None), ("b", "su", "w", None, None, "NEEDS_REVIEW", None), ("b", "par", "(A) b", None, None, None, None),
]
REAL_GOT = [  # photo, key, value, n, display, raw, status
    ("a", "k1", "12", 12.0, "12", "12", "KNOWN"), ("a", "k2", "n", None, "n", "n", "KNOWN"), ("a", "k9", "Y.", None, "Y", "Y", "NEEDS_REVIEW"), ("a", "k3", "n", None, "n", "n", "KNOWN"), ("a", "k8", "q", None, "q", "q", "KNOWN"), ("a", "k4", None, None, None, None, "NOT_PROVIDED"), ("a", "k5", "3", 3.0, "3", "3", "KNOWN"),
    ("a", "s1", "t", None, "t", "t", "NEEDS_REVIEW"), ("a", "s2", "r.a.s", None, "RAS", "RAS", "KNOWN"), ("b", "k1", "L", None, "L", "L", "KNOWN"), ("b", "k7", "2", 2.0, "2", "2", "KNOWN"), ("b", "k6", "5", 5.0, "5 kg", "5", "KNOWN"), ("b", "st", "v", None, "v", "v", "NEEDS_REVIEW"), ("b", "su", "no", None, "no", "no", "NEEDS_REVIEW"), ("b", "par", "a b", None, "a b", "a b", "KNOWN"),
]
REAL_WANT = [
    ("a", "k1", True, "KNOWN"), ("a", "k2", True, "NEEDS_REVIEW"), ("a", "k3", False, "KNOWN"), ("a", "k4", True, "NOT_PROVIDED"), ("a", "k5", False, "KNOWN"), ("a", "s1", True, "NEEDS_REVIEW"), ("a", "s2", True, "KNOWN"), ("a", "s3", False, "missing"),
    ("b", "k1", True, "KNOWN"), ("b", "k2", True, "KNOWN"), ("b", "k6", True, "KNOWN"), ("b", "k0", False, "missing"), ("b", "st", True, "NEEDS_REVIEW"), ("b", "su", True, "NEEDS_REVIEW"), ("b", "par", True, "KNOWN"),
]


@query("real_scores", f"SELECT * FROM (VALUES {_values(REAL_WANT)}) v(photo, key, good, status)")
def real_scores(spark, sf_dir):
    truth = spark.createDataFrame(REAL_TRUTH, "photo string, key string, value string, accept array<string>, alt array<string>, status string, span string")
    typed = truth.withColumns({"raw": F.col("value"), "dtype": F.when(F.col("key") == "k6", "kg").when(F.col("key").isin("k1", "k2"), "int").otherwise("other"), "lo": F.lit(None).cast("double"), "hi": F.lit(None).cast("double")})
    got = spark.createDataFrame(REAL_GOT, "photo string, key string, value string, n double, display string, raw string, status string")
    return evaluate.real_scores(parse(typed).drop("raw", "dtype", "lo", "hi"), got)


@query("text_truths", "SELECT * FROM (VALUES (0, 'NOT_PROVIDED', NULL, false), (1, 'NOT_PROVIDED', NULL, false), (2, 'NOT_APPLICABLE', '—', false), (3, 'KNOWN', 'F�s', true), (4, 'KNOWN', 'mot', false)) v(id, status, raw, glyph_missing)")
def text_truths(spark, sf_dir):
    rows = spark.createDataFrame([(0, None), (1, ""), (2, "– —"), (3, "F�s"), (4, "mot")], "id bigint, raw string")
    return rows.select("id", evaluate.text_truth(F.col("raw")).alias("t")).select("id", "t.*")


@query("truth_counts", "SELECT l_returnflag AS page_type, CASE WHEN l_tax < 0.06 THEN 'KNOWN' ELSE 'NOT_PROVIDED' END AS status, count(*)::BIGINT AS n FROM lineitem WHERE l_suppkey % 10 + 1 BETWEEN 8 AND 10 GROUP BY 1, 2")
def truth_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumns({"patient": F.col("l_suppkey") % 10 + 1, "status": F.when(F.col("l_tax") < 0.06, "KNOWN").otherwise("NOT_PROVIDED"), "page_type": F.col("l_returnflag")})
    return evaluate.truth_counts(rows.where(evaluate.in_split(F.col("patient"), "test")))


@query("report_order", "SELECT * FROM (VALUES ('text', 1), ('cell', 2), ('check', 3), ('radio', 4), ('other', 5)) v(kind, place)")
def report_order(spark, sf_dir):
    return evaluate.reported(spark.createDataFrame([(k,) for k in ("radio", "other", "cell", "text", "check")], "kind string"))


@query("page_confidences", """SELECT s_suppkey AS page, round((0.7 + 0.3 * a) * CASE WHEN s_suppkey % 3 > 0 THEN 1 ELSE 0.9 END, 6)::DOUBLE AS page, CASE WHEN s_suppkey % 2 = 0 THEN 0.8 ELSE 0.88 END::DOUBLE AS threshold FROM supplier""".replace("s_suppkey AS page, round((0.7 + 0.3 * a)", "s_suppkey AS id, round((0.7 + 0.3 * (s_suppkey % 100) / 100.0::DOUBLE)").replace("::DOUBLE AS page, CASE", "::DOUBLE AS confidence, CASE"))
def page_confidences(spark, sf_dir):
    s = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier")
    return rows.select(s.alias("id"), F.round(decide.page_confidence((s % 100) / 100.0, s % 3 > 0), 6).alias("confidence"), decide.known_threshold(F.when(s % 2 == 0, 900).otherwise(899)).alias("threshold"))


# ---- layouts

@query("label_lines")
def label_lines(spark, sf_dir):
    """The most similar line of each label on pages of a few lines; SQL has no such similarity."""
    lines = spark.createDataFrame([(1, 1, "poids (kg) : 62"), (1, 2, "taille"), (1, 3, "poid"), (2, 1, "groupage a b o rhesus"), (2, 2, "")], "page bigint, line bigint, text string")
    best = match.best_lines(["poids (kg)", "taille", "groupage", "rhesus"], lines)
    inside = match.label_in_line(F.col("label"), F.col("text"))
    return best.join(lines, ["page", "line"]).select("page", "label", "line", F.round("similarity", 4).alias("similarity"), F.round(inside["score"], 4).alias("inside"), inside["at"].alias("at"))


@query("merged_bands", """WITH b AS (SELECT l_orderkey AS page, l_quantity * 10 AS top, l_quantity * 10 + 12 AS bottom FROM lineitem), f AS (SELECT *, CASE WHEN (top + bottom) / 2 - lag((top + bottom) / 2) OVER w >= 40 OR lag(top) OVER w IS NULL THEN 1 ELSE 0 END AS first FROM b WINDOW w AS (PARTITION BY page ORDER BY top, bottom)),
i AS (SELECT *, sum(first) OVER (PARTITION BY page ORDER BY top, bottom ROWS UNBOUNDED PRECEDING) AS island FROM f) SELECT page, min(top) AS top, max(bottom) AS bottom FROM i GROUP BY page, island""")
def merged_bands(spark, sf_dir):
    q = F.col("l_quantity") * 10
    return geometry.merged_bands(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), q.alias("top"), (q + 12).alias("bottom")))


_LINES = "SELECT DISTINCT l_orderkey AS page, l_linenumber AS line, l_quantity * 8 AS b FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_discount, l_tax) AS n FROM lineitem) WHERE n = 1"


def _lines(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax")
    rows = table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(w)).where("n = 1")
    return rows.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("line"), F.lit(0.0).alias("a"), (F.col("l_quantity") * 8).alias("b"), F.lit(0.0).alias("lo"), F.lit(100.0).alias("hi"))


@query("between_lines", f"""WITH l AS ({_LINES}), p AS (SELECT o_orderkey AS page, 1 AS point, 200.0 AS v FROM orders) SELECT p.page, p.point, (SELECT arg_max(line, {{'a': b, 'b': -line}}) FROM l WHERE l.page = p.page AND b - v < -2) AS before, (SELECT arg_min(line, {{'a': b, 'b': line}}) FROM l WHERE l.page = p.page AND b - v > 2) AS after FROM p""")
def between_lines(spark, sf_dir):
    points = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), F.lit(1).alias("point"), F.lit(120.0).alias("t"), F.lit(200.0).alias("v"))
    return geometry.between_lines(points, _lines(spark, sf_dir))


@query("snapped_points", f"""WITH l AS ({_LINES}), p AS (SELECT o_orderkey AS page, 1 AS point, 200.0::DOUBLE AS v FROM orders) SELECT p.page, p.point, coalesce((SELECT arg_min(b, {{'a': abs(b - v), 'b': b}}) FROM l WHERE l.page = p.page AND abs(b - v) <= 30), v)::DOUBLE AS v FROM p""")
def snapped_points(spark, sf_dir):
    points = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), F.lit(1).alias("point"), F.lit(50.0).alias("t"), F.lit(200.0).alias("v"), F.lit(30.0).alias("tolerance"))
    return geometry.snapped(points, _lines(spark, sf_dir))


@query("page_angles", "SELECT l_orderkey AS page, round(coalesce(median(degrees(atan((l_tax - 0.04)))) FILTER (WHERE l_quantity * 10 > 200), 0), 6)::DOUBLE + 0 AS angle FROM lineitem GROUP BY 1")
def page_angles(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_tax") - 0.04).alias("a"), F.lit(0.0).alias("lo"), (F.col("l_quantity") * 10).alias("hi"))
    return geometry.page_angle(rows).select("page", (F.round("angle", 6) + 0.0).alias("angle"))


@query("moved_boxes", """WITH b AS (SELECT p_partkey AS id, p_size::DOUBLE AS x0, p_size * 2::DOUBLE AS y0, p_size + 10::DOUBLE AS x1, p_size * 2 + 5::DOUBLE AS y1 FROM part)
SELECT id, least(0.5 * x0 - y0, 0.5 * x0 - y1, 0.5 * x1 - y0, 0.5 * x1 - y1)::INT AS x0, greatest(0.5 * x0 + y0, 0.5 * x0 + y1, 0.5 * x1 + y0, 0.5 * x1 + y1)::DOUBLE AS top,
 greatest(0, x0 - 20)::INT AS left_, least(40, x1)::INT AS right_, round(x0 * cos(radians(3)) + y0 * sin(radians(3)), 6) AS rx, round(x0 / (0.001 * x0 + 1), 6) AS px, abs(x0 - y0) < 6 AS level FROM b""".replace("::INT AS x0", "::DOUBLE AS x0"))
def moved_boxes(spark, sf_dir):
    size = F.col("p_size").cast("double")
    box = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), size.alias("x0"), (size * 2).alias("y0"), (size + 10).alias("x1"), (size * 2 + 5).alias("y1"))
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    image = geometry.rect_image((0.5, -1.0, 0.0, 0.5, 1.0, 0.0), x0, y0, x1, y1)
    cut = geometry.clipped(x0 - 20, y0, x1, y1, F.lit(40.0), F.lit(1000.0))
    zero = F.lit(0.0)
    return box.select("id", image["x0"].alias("x0"), image["y1"].alias("top"), cut["x0"].alias("left_"), cut["x1"].alias("right_"), F.round(geometry.rotated(x0, y0, F.lit(3.0), zero, zero)["x"], 6).alias("rx"),
                      F.round(geometry.projected((1, 0, 0, 0, 1, 0, 0.001, 0, 1), x0, y0)["x"], 6).alias("px"), geometry.same_line(x0, y0).alias("level"))


OPTION_LINES = [(1, "groupage : a b o ab rhesus (-) rhesus (+)", 8, 0.0, 410.0, ["a", "b", "o", "ab", "rhesus (-)", "rhesus (+)"]), (2, "groupage a o", 8, 10.0, 130.0, ["a", "b", "o", "ab"]), (3, "type maternite privee", 4, 0.0, 210.0, ["maternité", "maternite publique"]), (4, "", 0, 0.0, 10.0, ["a"])]


@query("option_places", """SELECT id, option, x::DOUBLE AS x FROM (VALUES (1, 'a', 115.0), (1, 'b', 135.0), (1, 'o', 155.0), (1, 'ab', 180.0), (1, 'rhesus (-)', 250.0), (1, 'rhesus (+)', 360.0), (2, 'a', 105.0), (2, 'o', 125.0), (3, 'maternité', 95.0)) v(id, option, x)""")
def option_places(spark, sf_dir):
    rows = spark.createDataFrame(OPTION_LINES, "id bigint, line string, used int, x0 double, x1 double, options array<string>")
    places = geometry.option_centres(F.col("line"), F.col("used"), F.col("x0"), F.col("x1"), F.col("options"))
    return rows.select("id", F.explode(places).alias("p")).select("id", "p.option", F.round("p.x", 4).alias("x"))


@query("label_rest", "SELECT * FROM (VALUES (1, 'a', 0, 'Âge', '31 ans'), (1, 'a', 1, 'Age', '31 ans'), (2, 'b', 0, 'Poids', '')) v(id, name, choice, text, rest)")
def label_rest(spark, sf_dir):
    rows = spark.createDataFrame([(1, "a", "Âge|Age", "Âge : 31 ans.", 3), (2, "b", "Poids", "Poids :", 5)], "id bigint, name string, anchor string, line string, used int")
    choices = geometry.label_choices(rows.select("anchor").distinct())
    return rows.join(choices, "anchor").select("id", "name", "choice", "text", geometry.text_after_label(F.col("line"), F.col("used")).alias("rest"))


@query("row_anchors", "SELECT \"row\", band, share::DOUBLE AS share FROM (VALUES ('r1', 0, 0.25), ('r2', 0, 0.9), ('r3', 1, 0.0), ('r4', 2, 0.5)) v(row, band, share)".replace("v(row,", 'v("row",'))
def row_anchors(spark, sf_dir):
    rows = spark.createDataFrame([(1, "r0", 5.0), (1, "r1", 35.0), (1, "r2", 100.0), (1, "r3", 110.0), (1, "r4", 260.0), (1, "r5", 400.0)], "page int, row string, y double")
    return geometry.row_anchors(rows, spark.createDataFrame([(1, y) for y in (10.0, 110.0, 210.0, 310.0)], "page int, y double")).select("row", "band", F.round("share", 6).alias("share"))


PIECES = [(1, True, 0.0, 100.0, 0.0, 50.0), (1, True, 0.001, 100.5, 60.0, 120.0), (1, True, 0.0, 300.0, 0.0, 50.0), (1, True, 0.0, 100.0, 200.0, 260.0), (2, False, 0.0, 10.0, 0.0, 9.0)]


@query("merged_segments", "SELECT page, across, line, a::DOUBLE AS a, b::DOUBLE AS b, lo::DOUBLE AS lo, hi::DOUBLE AS hi FROM (VALUES (1, true, 0, 0.0, 100.0, 200.0, 260.0), (1, true, 1, 0.000545, 100.272727, 0.0, 120.0), (1, true, 2, 0.0, 300.0, 0.0, 50.0), (2, false, 0, 0.0, 10.0, 0.0, 9.0)) v(page, across, line, a, b, lo, hi)")
def merged_segments(spark, sf_dir):
    got = geometry.merged_segments(spark.createDataFrame(PIECES, "page bigint, across boolean, a double, b double, lo double, hi double"))
    return got.withColumns({"a": F.round("a", 6), "b": F.round("b", 6)}).withColumn("line", F.row_number().over(Window.partitionBy("page", "across").orderBy("b")) - 1)


@query("diagonal_spans", "SELECT 1 AS page, 'c' AS col, 'r1,r2,r3' AS keys, 0.0::DOUBLE AS x0, 62.0::DOUBLE AS y1")
def diagonal_spans(spark, sf_dir):
    pieces = spark.createDataFrame([(1, "c", 0.0, 2.0, 18.0, 20.0, 9.0, 11.0, 45.0), (1, "c", 20.0, 22.0, 38.0, 40.0, 29.0, 31.0, 45.0), (1, "c", 40.0, 44.0, 58.0, 62.0, 49.0, 53.0, 45.0), (1, "c", 200.0, 2.0, 210.0, 12.0, 205.0, 7.0, 0.0)], "page bigint, col string, x0 double, y0 double, x1 double, y1 double, cx double, cy double, slant double")
    rows = spark.createDataFrame([(1, "c", f"r{i}", 20.0 * i - 20, 20.0 * i) for i in (1, 2, 3, 4)], "page bigint, col string, key string, y0 double, y1 double")
    return geometry.diagonal_spans(pieces, rows, 6.0).select(F.col("page").cast("int").alias("page"), "col", F.array_join("keys", ",").alias("keys"), "x0", "y1")


@query("learning_means", """WITH c AS (SELECT p_brand AS key, p_size::DOUBLE AS s FROM part) SELECT key, count(*)::BIGINT AS n, round(avg(s / 10), 4) AS mean_rel_x0, round(avg((s + 5 - 30) / 10), 4) AS mean_rel_x1, round(avg(25.0::DOUBLE / 75), 4) AS mean_iou FROM c GROUP BY 1""")
def learning_means(spark, sf_dir):
    s = F.col("p_size").cast("double")
    at = {"l_x0": F.lit(0.0), "l_y0": F.lit(0.0), "l_x1": F.lit(30.0), "l_y1": F.lit(10.0), "d_x0": s, "d_y0": F.lit(0.0), "d_x1": s + 5, "d_y1": F.lit(10.0), "f_x0": s, "f_y0": F.lit(5.0), "f_x1": s + 5, "f_y1": F.lit(15.0)}
    _, means = records.learning_set(table(spark, sf_dir, "part").withColumn("key", F.col("p_brand")).withColumns(at))
    return means.select("key", "n", "mean_rel_x0", "mean_rel_x1", "mean_iou")


@query("crop_readings", "SELECT id, text, score::DOUBLE AS score FROM (VALUES (1, 'Fès', 0.9), (2, 'Fs', 0.45), (3, '', 0.3), (4, '12°C', 0.8)) v(id, text, score)")
def crop_readings(spark, sf_dir):
    from casebook.sources.readers import read_lines

    rows = spark.createDataFrame([(1, "Fès ", 0.9), (2, "F漢s", 0.9), (3, "漢", 0.6), (4, "12°C", 0.8)], "id bigint, text string, score double")
    return rows.select("id", read_lines(F.col("text"), F.col("score")).alias("r")).select("id", "r.text", "r.score")


@query("label_stripped", "SELECT * FROM (VALUES (1, '62 kg'), (2, 'oui'), (3, '5 45'), (4, NULL)) v(id, text)")
def label_stripped(spark, sf_dir):
    rows = spark.createDataFrame([(1, "Poids : 62 kg", "Poids :"), (2, "oui", "Poids"), (3, "Poid5 45", "Poids"), (4, None, "Poids")], "id bigint, x string, label string")
    got = X.without_label(F.col("x"), F.col("label"))
    return rows.select("id", F.when(F.col("x").isNotNull(), X.without_separators(got)).alias("text"))
