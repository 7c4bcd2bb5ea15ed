"""The engine's queries over the driver's tables, each with its SQL for DuckDB where SQL can express it.

Operators act on form records; the tables stand in for them: documents are captured contents, events a record log,
customers coded patients, orders visits, lineitem evaluation rows. Readings are a fixed corpus of dirty texts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from casebook.functions import text as X
from casebook.operators import control, decide, decode, evaluate, geometry, lifecycle, match, records, rules
from casebook.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _quote(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(map(_quote, r)) + ")" for r in rows)


READINGS = [
    None, "", "   ", "-", "— –", "_._", "?", "Inconnu", " nsp ", "ne sait pas", "NF", "n.f", "non fait", "12", "1 2", "l2", "O8", "3,5 kg", "37.2°C", "372", "1Z5", "16SA+3j",
    "16+3", "20 SA", "12/8", "120/80", "12080", "13/9", "80/120", "l20/8O", "12/03/2024", "1/1/24", "31/02/2024", "12032024", "05-11-1989", "5.6.2035", "12I03I2024", "2021", "en 1998",
    "Neg", "nég", "mes", "pos", "+", "A+", "Oui", "NON", "Reçu", "présent", "aucune", "nou", "F", "Féminin", "garçon", "M", "x", "ab 12 c", " 2026-823 001", "3489", "348g", "350.g", "Œdème", "Straße", "L'été  à Fès",
    "RAS", "4S.", "Normale", "AI Hoceïma", "12 cm", "5 jours", "170cm", "1.2.3", "abc", "99", "A5", "0", "ø",
    "1210312024", "12/0312024", "M/03/2024", "12/3/202", "l200", "O8 abc", "3485.9", "350 .q", "A6 SA + 2", "20+9", "16SA + Λ jours", "1998", "19 98", "104/74", "10474", "1l0/7O", "prec", "nonn", "Ouii", "pas", "po", "3.485,5",
]
READING_VALUES = f"(VALUES {_values((i, r) for i, r in enumerate(READINGS))}) v(id, x)"


def _readings(spark) -> DataFrame:
    return spark.createDataFrame(list(enumerate(READINGS)), "id bigint, x string")


def _reading_query(name: str, columns: dict, sql: str) -> None:
    def run(spark, sf_dir):
        return _readings(spark).select("id", *(f(F.col("x")).alias(c) for c, f in columns.items()))

    query(name, f"{sql}")(run)


ACC, PLAIN = X.ACCENTED, X.PLAIN
FOLD = f"trim(regexp_replace(translate(replace(replace(lower(x), 'œ', 'oe'), 'ß', 'ss'), '{ACC}', '{PLAIN}'), '\\s+', ' ', 'g'))"
SQUEEZE = "trim(regexp_replace(x, '\\s+', ' ', 'g'))"
REPAIR = f"translate(regexp_replace(trim(x), '(?i)(\\s*(sa|cm|mm|kg|g/dl|g/l|°c|℃|°|c|jours?|j|g))+\\s*$', ''), '{X.LOOKALIKES}', '{X.DIGITS}')"
NUM = lambda e: f"try_cast(replace(nullif(regexp_extract({e}, '(\\d+(?:[.,]\\d+)?)', 1), ''), ',', '.') AS DOUBLE)"
STRICT = f"CASE WHEN NOT regexp_matches({REPAIR}, '[^0-9 .,/\\-+]') THEN {NUM(REPAIR)} END"
LIST = lambda ws: "(" + ", ".join(map(_quote, ws)) + ")"

_reading_query("fold_text", {"folded": X.fold, "squashed": X.squash}, f"SELECT id, {FOLD} AS folded, regexp_replace({FOLD}, '[\\s.,;:''’\\-_/]', '', 'g') AS squashed FROM {READING_VALUES}")
_reading_query("markers", {"mark": X.marker}, f"""SELECT id, CASE WHEN x IS NULL OR {SQUEEZE} = '' THEN NULL WHEN regexp_matches({SQUEEZE}, '^[\\s\\-–—_~.]+$') THEN 'dash'
  WHEN trim({FOLD}, ' .') IN {LIST(X.UNKNOWN)} THEN 'unknown' WHEN trim({FOLD}, ' .') IN {LIST(X.NOT_DONE)} THEN 'not_done' END AS mark FROM {READING_VALUES}""")
_reading_query("digit_repair", {"repaired": X.digit_repair, "n": lambda x: X.number(x)}, f"SELECT id, {REPAIR} AS repaired, {NUM('x')} AS n FROM {READING_VALUES}")
_TIGHT = f"regexp_replace({SQUEEZE}, '\\s', '', 'g')"
_MENDED = lambda e: f"regexp_replace(regexp_replace({e}, '^(\\d\\d)[1lI|](\\d\\d)[1lI|/](\\d{{4}})$', '\\1/\\2/\\3'), '^(\\d\\d)/(\\d\\d)[1lI|](\\d{{4}})$', '\\1/\\2/\\3')"
_DATED = lambda e: f"""t AS (SELECT id, x, {e} AS s0 FROM {READING_VALUES}), m AS (SELECT id, x, s0, {_MENDED('s0')} AS s1 FROM t), f AS (SELECT id, x, s0 <> s1 AS slashed, {REPAIR.replace('trim(x)', 'trim(s1)')} AS s FROM m),
p AS (SELECT id, x, slashed, NOT regexp_matches(s, '^\\d{{1,2}}[/.\\-]\\d{{1,2}}[/.\\-]\\d{{2,4}}$') AS bare, CASE WHEN regexp_matches(s, '^\\d{{1,2}}[/.\\-]\\d{{1,2}}[/.\\-]\\d{{2,4}}$') THEN regexp_extract(s, '^(\\d{{1,2}})[/.\\-](\\d{{1,2}})[/.\\-](\\d{{2,4}})$', ['d', 'm', 'y'])
  WHEN regexp_matches(s, '^\\d{{8}}$') THEN regexp_extract(s, '^(\\d{{2}})(\\d{{2}})(\\d{{4}})$', ['d', 'm', 'y']) END AS g FROM f),
q AS (SELECT id, x, slashed OR bare AS mended, g.d::INT AS d, g.m::INT AS m, CASE WHEN g.y::INT < 100 THEN g.y::INT + 2000 ELSE g.y::INT END AS y FROM p),
r AS (SELECT id, x, mended, CASE WHEN y BETWEEN 1990 AND 2035 THEN try_cast(printf('%04d-%02d-%02d', y, m, d) AS DATE) END AS day FROM q)"""  # noqa: E731
_M11 = f"regexp_replace({_TIGHT}, '^M([/.\\-])', '11\\1')"
_YEAR = f"replace({REPAIR.replace('trim(x)', SQUEEZE)}, ' ', '')"
_reading_query("parse_date", {"iso": X.iso_date}, f"WITH {_DATED(_M11)} SELECT id, strftime(day, '%Y-%m-%d') AS iso FROM r")
_reading_query("parse_date_or_year", {"iso_or_year": X.date_or_year}, f"WITH {_DATED(_TIGHT)} SELECT id, coalesce(strftime(day, '%Y-%m-%d'), CASE WHEN regexp_matches({_YEAR}, '^(19|20)\\d\\d$') THEN {_YEAR} END) AS iso_or_year FROM r")
_reading_query("parse_bp", {"systolic": lambda x: X.blood_pressure(x)["systolic"], "diastolic": lambda x: X.blood_pressure(x)["diastolic"], "issue": lambda x: X.blood_pressure(x)["issue"]}, f"""
WITH f AS (SELECT id, regexp_replace({REPAIR}, '\\s', '', 'g') AS s FROM {READING_VALUES}),
g AS (SELECT id, CASE WHEN regexp_matches(s, '^\\d{{1,3}}/\\d{{1,3}}$') THEN regexp_extract(s, '^(\\d{{1,3}})/(\\d{{1,3}})$', ['a', 'b']) WHEN regexp_matches(s, '^\\d{{5,6}}$') THEN regexp_extract(s, '^(\\d{{3}})(\\d{{2,3}})$', ['a', 'b']) END AS g FROM f),
h AS (SELECT id, g.a::INT AS a, g.b::INT AS b FROM g), k AS (SELECT id, CASE WHEN a < 30 AND b < 20 THEN a * 10 ELSE a END AS a, CASE WHEN a < 30 AND b < 20 THEN b * 10 ELSE b END AS b FROM h)
SELECT id, a AS systolic, b AS diastolic, CASE WHEN a IS NULL THEN 'could not read as systolic/diastolic' WHEN NOT (a BETWEEN 60 AND 250 AND b BETWEEN 30 AND 150 AND a > b) THEN 'implausible blood pressure' END AS issue FROM k""")
_WD = r"'^\s*([\dAΛ]{1,2})\s*(?:S\s*A|SA|5A|S)?\s*\+\s*([\dAΛ])\s*[jJ]?'"
_WEEK, _DAY = (f"try_cast(translate(regexp_extract({SQUEEZE}, {_WD}, {i}), 'AΛ', '11') AS INT)" for i in (1, 2))
_reading_query("parse_weeks", {"weeks": X.weeks}, f"SELECT id, CASE WHEN {_DAY} BETWEEN 0 AND 6 THEN round({_WEEK} + {_DAY} / 7.0::DOUBLE, 1) ELSE {STRICT} END AS weeks FROM {READING_VALUES}")
_reading_query("parse_int", {"value": lambda x: X.integer(x)["value"], "issue": lambda x: X.integer(x)["issue"]}, f"""SELECT id, floor({STRICT})::BIGINT AS value,
  CASE WHEN ({STRICT}) IS NULL THEN 'not a number' WHEN NOT regexp_matches({REPAIR}, '^\\s*\\d+\\s*$') THEN 'extra characters' END AS issue FROM {READING_VALUES}""")
_reading_query("parse_measure", {"plain": lambda x: X.measure(x, "float"), "temp": lambda x: X.measure(x, "temp"), "issue": lambda x: X.range_issue(X.measure(x, "float"), F.lit(30), F.lit(200))}, f"""SELECT id, {STRICT} AS plain,
  CASE WHEN ({STRICT}) > 100 THEN ({STRICT}) / 10 ELSE {STRICT} END AS temp, CASE WHEN NOT (({STRICT}) BETWEEN 30 AND 200) THEN 'out of plausible range' END AS issue FROM {READING_VALUES}""")
_GRAM = lambda cls: f"regexp_replace({SQUEEZE}, '^\\s*(\\d{{3,4}})\\s*[.,]?\\s*[{cls}]\\s*$', '\\1')"
_G = lambda cls: f"CASE WHEN NOT regexp_matches({REPAIR.replace('trim(x)', f'trim({_GRAM(cls)})')}, '[^0-9 .,/\\-+]') THEN {NUM(REPAIR.replace('trim(x)', f'trim({_GRAM(cls)})'))} END"
_reading_query("parse_grams", {"grams": X.grams, "grams_compat": lambda x: X.grams(x, True)}, f"SELECT id, {_G('gqa')} AS grams, {_G('9gqa')} AS grams_compat FROM {READING_VALUES}")
_F2 = f"replace({FOLD}, ' ', '')"
_reading_query("parse_posneg", {"sign": X.pos_neg}, f"""SELECT id, CASE WHEN {_F2} LIKE 'neg%' OR {_F2} = 'n' OR regexp_matches({_F2}, '^(?:[mn][eiy][gsyq5][.,]?)+$') THEN 'negative'
  WHEN {_F2} LIKE 'pos%' OR {_F2} LIKE '+%' OR {_F2} LIKE '%+' THEN 'positive' END AS sign FROM {READING_VALUES}""")
_FT = f"trim({FOLD}, ' .,')"
_reading_query("parse_yesno", {"yes": X.yes_no}, f"""SELECT id, CASE WHEN {_FT} IN ('oui', 'non') THEN {_FT} = 'oui' WHEN {_FT} IN {LIST(X.YES_WORDS)} OR {_FT} LIKE 'rec%' THEN true
  WHEN regexp_matches({_FT}, '^[rpkh][ea][cs]') THEN true WHEN {_FT} IN {LIST(X.NO_WORDS)} OR {_FT} LIKE 'neg%' THEN false
  WHEN substr({_FT}, 1, 1) IN ('n', 'o') AND length({_FT}) <= 4 THEN substr({_FT}, 1, 1) = 'o' END AS yes FROM {READING_VALUES}""")
_reading_query("parse_sex_code", {"sex": X.sex, "code": X.code}, f"""SELECT id, CASE WHEN trim({FOLD}, ' .') IN ('f', 'feminin', 'fille') THEN 'F' WHEN trim({FOLD}, ' .') IN ('m', 'masculin', 'garcon', 'h') THEN 'M' END AS sex,
  replace(upper(regexp_replace(x, '\\s+', '', 'g')), 'ẞ', 'SS') AS code FROM {READING_VALUES}""")
_reading_query("clinical_alias", {"text": X.clinical_alias}, f"""WITH f AS (SELECT id, {SQUEEZE} AS s, regexp_replace({SQUEEZE}, '\\bAI( [A-Z])', 'Al\\1', 'g') AS t FROM {READING_VALUES})
SELECT id, CASE WHEN regexp_matches(s, '^\\w?[aA4Λ][sS5]\\.?$') THEN 'RAS' WHEN t = 'Colorés' THEN 'Colorées' WHEN t = 'Normale' THEN 'Normal' WHEN t = 'Aucune' THEN 'Aucun' WHEN t = 'Négatif' THEN 'Neg' WHEN t = 'Positif' THEN 'Pos' ELSE t END AS text FROM f""")


@query("fold_documents", f"SELECT doc_id, sha256({FOLD.replace('lower(x)', 'lower(text)')}) AS folded FROM documents")
def fold_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.fold(F.col("text")).cast("binary"), 256).alias("folded"))


@query("unicode_fold")
def unicode_fold(spark, sf_dir):
    from casebook.functions.unfold import first_letter, unicode_fold

    return _readings(spark).select("id", unicode_fold("x").alias("folded"), first_letter("x").alias("first"))


@query("lexicon_snap")
def lexicon_snap(spark, sf_dir):
    return match.lexicon_snap(_readings(spark), "x", ["Normal", "Négatif", "Positif", "Oui", "Non", "Oedème", "Présent", "Absent"])


# ---- lifecycle

@query("dup_capture", """WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents)
SELECT doc_id, sha256, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY sha256) THEN 'PENDING_AI' ELSE 'SUSPECTED_DUPLICATE' END AS state FROM h""")
def dup_capture(spark, sf_dir):
    return lifecycle.duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id").select("doc_id", "sha256", "state")


EVENT_EDGES = [("view", "click"), ("view", "view"), ("view", "signup"), ("click", "signup"), ("click", "view"), ("signup", "purchase"), ("signup", "view"), ("purchase", "view"), ("error", "view")]


@query("state_transitions_check", f"""WITH l AS (SELECT event_id, user_id, event_type AS new_state, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old_state FROM events)
SELECT event_id, user_id, old_state, new_state FROM l WHERE old_state IS NOT NULL AND (old_state, new_state) NOT IN ({', '.join(f"('{a}', '{b}')" for a, b in EVENT_EDGES)})""")
def state_transitions_check(spark, sf_dir):
    log = lifecycle.transitions(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", "event_id").withColumnRenamed("event_type", "new_state")
    return lifecycle.illegal(log, spark.createDataFrame(EVENT_EDGES, "old_state string, new_state string")).select("event_id", "user_id", "old_state", "new_state")


@query("legal_transitions", "SELECT split_part(e, ' ', 1) AS old_state, split_part(e, ' ', 2) AS new_state FROM (SELECT unnest(string_split('CAPTURED PENDING_AI, CAPTURED SUSPECTED_DUPLICATE, PENDING_AI AI_PROCESSED, PENDING_AI PROCESSING_FAILED, AI_PROCESSED TO_REVIEW, TO_REVIEW VALIDATED, TO_REVIEW PENDING_AI, TO_REVIEW MANUAL_REVIEW_REQUIRED, VALIDATED PATIENT_LINKED, PATIENT_LINKED SAVED, SAVED SYNCED, SAVED SYNC_FAILED, PROCESSING_FAILED PENDING_AI, PROCESSING_FAILED MANUAL_REVIEW_REQUIRED, SYNC_FAILED SAVED, SYNC_FAILED MANUAL_REVIEW_REQUIRED, SUSPECTED_DUPLICATE PENDING_AI, SUSPECTED_DUPLICATE MANUAL_REVIEW_REQUIRED, MANUAL_REVIEW_REQUIRED TO_REVIEW, MANUAL_REVIEW_REQUIRED PENDING_AI', ', ')) AS e)")
def legal_transitions(spark, sf_dir):
    return lifecycle.edge_dim(spark)


@query("latest_state", "SELECT user_id, arg_max(event_type, {'a': ts, 'b': event_id}) AS event_type FROM events GROUP BY user_id")
def latest_state(spark, sf_dir):
    return lifecycle.latest(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", "event_id")


@query("state_counts_zero_filled", """WITH l AS (SELECT user_id, arg_max(event_type, {'a': ts, 'b': event_id}) AS s FROM events GROUP BY user_id), d(event_type) AS (VALUES ('view'), ('click'), ('signup'), ('purchase'), ('error'), ('archived'))
SELECT d.event_type, count(l.s)::BIGINT AS n FROM d LEFT JOIN l ON l.s = d.event_type GROUP BY 1""")
def state_counts(spark, sf_dir):
    dim = spark.createDataFrame([(s,) for s in ("view", "click", "signup", "purchase", "error", "archived")], "event_type string")
    return lifecycle.counts_by_state(latest_state(spark, sf_dir), "event_type", dim)


_CONTROL = ["captured", "failed", "processed", "validated", "linked", "sync_failed", "sync_again", "synced", "captured_duplicate", "retried", "unreadable", "manual", "answered", "waiting", "sync_waiting", "processed_unknown"]
_CONTROL_SQL = f"SELECT user_id AS record, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_id, CASE WHEN lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 'captured' ELSE ({_CONTROL!r})[1 + (event_id * 7 + (event_id // 16) * 3) % 16] END AS event FROM events"


def _control(spark, sf_dir) -> DataFrame:
    """Control events of records: users' events, the first a capture, the others dealt over all kinds by their number."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, _CONTROL)), (F.lit(1) + (e * 7 + F.floor(e / 16) * 3) % 16).cast("int"))
    rows = table(spark, sf_dir, "events").withColumns({"seq": F.row_number().over(w).cast("bigint"), "event": F.when(F.lag("event_id").over(w).isNull(), "captured").otherwise(kind)})
    return rows.select(F.col("user_id").alias("record"), "seq", "event", F.col("ts").cast("timestamp").alias("at"))


def _moves_sql() -> str:
    rows = [(event, state, "|".join(nexts), count, wrong) for (event, state), (nexts, count, wrong) in control.MOVES.items()]
    return f"(VALUES {_values(rows)}) m(event, before, nexts, count, wrong)"


_FOLD_SQL = f"""WITH RECURSIVE e AS ({_CONTROL_SQL}), f(record, seq, event, old_state, state, attempts, error, accepted, nexts) AS (
 SELECT record, 0::BIGINT, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, 0, NULL::VARCHAR, false, '' FROM (SELECT DISTINCT record FROM e)
 UNION ALL SELECT record, seq, event, old_state, CASE WHEN nexts <> '' THEN string_split(nexts, '|')[-1] ELSE old_state END, attempts, CASE WHEN nexts <> '' THEN CASE WHEN wrong THEN event END ELSE error END, accepted, nexts
 FROM (SELECT e.record, e.seq, e.event, f.state AS old_state, f.error, m.event IS NOT NULL AS accepted, m.wrong, CASE m.count WHEN 1 THEN f.attempts + 1 WHEN -1 THEN 0 ELSE f.attempts END AS attempts,
   CASE WHEN m.event IS NULL THEN '' WHEN m.count = 1 AND f.attempts + 1 >= 3 THEN 'PROCESSING_FAILED' ELSE m.nexts END AS nexts
   FROM f JOIN e ON e.record = f.record AND e.seq = f.seq + 1 LEFT JOIN {_moves_sql()} ON m.event = e.event AND m.before = coalesce(f.state, ''))),
g AS (SELECT * FROM f WHERE seq > 0)"""


@query("control_fold", f"{_FOLD_SQL} SELECT record, seq, event, old_state, state, attempts, error, accepted FROM g")
def control_fold(spark, sf_dir):
    return control.fold(_control(spark, sf_dir)).drop("moves")


@query("history_log", f"""{_FOLD_SQL}, h AS (SELECT record, seq, old_state, string_split(nexts, '|') AS m, unnest(range(0, len(string_split(nexts, '|')))) AS nth FROM g WHERE nexts <> '')
SELECT record, seq, nth::INT AS nth, CASE WHEN nth = 0 THEN old_state ELSE m[nth] END AS old_state, m[nth + 1] AS new_state FROM h""")
def history_log(spark, sf_dir):
    return control.history(control.fold(_control(spark, sf_dir)))


@query("legal_history", "SELECT NULL::BIGINT AS record, NULL::VARCHAR AS old_state, NULL::VARCHAR AS new_state WHERE false")
def legal_history(spark, sf_dir):
    """Moves of the folded history that are no edge of the state machine: none, whatever the events."""
    return lifecycle.illegal(control.history(control.fold(_control(spark, sf_dir))), lifecycle.edge_dim(spark)).select("record", "old_state", "new_state")


@query("retry_policy_fold", f"{_FOLD_SQL} SELECT record, arg_max(state, seq) AS state, arg_max(attempts, seq) AS attempts, arg_max(error, CASE WHEN true THEN seq END) FILTER (WHERE true) AS error FROM (SELECT record, seq, state, attempts, coalesce(error, '') AS error FROM g) GROUP BY record HAVING arg_max(state, seq) IS NOT NULL")
def retry_policy_fold(spark, sf_dir):
    return control.current(control.fold(_control(spark, sf_dir))).withColumn("error", F.coalesce("error", F.lit("")))


@query("sync_partition", f"{_FOLD_SQL}, l AS (SELECT record, arg_max(state, seq) AS state FROM g GROUP BY record) SELECT d.state, count(l.record)::BIGINT AS n FROM (VALUES {', '.join(f'({s!r})' for s in lifecycle.EDGES)}) d(state) LEFT JOIN l USING (state) GROUP BY 1")
def sync_partition(spark, sf_dir):
    """Records in each of the twelve states after all control events."""
    states = spark.createDataFrame([(s,) for s in lifecycle.EDGES], "state string")
    return lifecycle.counts_by_state(control.current(control.fold(_control(spark, sf_dir))).select("record", "state"), "state", states)


_TURN = "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'connection' WHEN event_id % 7 = 0 THEN 'unreadable_image' WHEN event_id % 11 = 0 THEN 'model' END AS code, event_id % 3 > 0 AS online, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'unknown' ELSE 'cover' END AS page_type FROM events"


@query("queue_outcomes", f"""SELECT event_id, CASE WHEN code = 'connection' THEN 'waiting' WHEN code = 'unreadable_image' THEN 'unreadable' WHEN code IS NOT NULL THEN 'failed' WHEN coalesce(page_type, 'unknown') = 'unknown' THEN 'processed_unknown' ELSE 'processed' END AS local,
 CASE WHEN NOT online OR code = 'connection' THEN 'waiting' WHEN code = 'unreadable_image' THEN 'unreadable' WHEN code IS NOT NULL THEN 'waiting' WHEN coalesce(page_type, 'unknown') = 'unknown' THEN 'processed_unknown' ELSE 'processed' END AS cloud FROM ({_TURN})""")
def queue_outcomes(spark, sf_dir):
    e = F.col("event_id")
    code = F.when(e % 5 == 0, "connection").when(e % 7 == 0, "unreadable_image").when(e % 11 == 0, "model")
    page = F.when(e % 4 == 0, None).when(e % 4 == 1, "unknown").otherwise("cover")
    rows = table(spark, sf_dir, "events").select("event_id", code.alias("code"), (e % 3 > 0).alias("online"), page.alias("page_type"))
    return rows.select("event_id", *[control.outcome(F.col("code"), mode, F.col("online"), F.col("page_type")).alias(mode) for mode in ("local", "cloud")])


@query("queue_oldest_first", "SELECT event_id, user_id, row_number() OVER (ORDER BY ts, event_id)::BIGINT AS place FROM events WHERE event_type IN ('error', 'signup')")
def queue_oldest_first(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").alias("captured_at"), F.col("event_id").alias("seq"), F.col("event_type").alias("state"))
    waiting = rows.where(F.col("state").isin("error", "signup"))
    return control.placed(waiting, F.date_trunc("hour", "captured_at"), "captured_at", "seq").select("event_id", "user_id", "place")


@query("link_last_wins", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def link_last_wins(spark, sf_dir):
    return lifecycle.last_wins(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey")


@query("lifecycle_stream", f"{_FOLD_SQL} SELECT record::VARCHAR AS record, seq, event, old_state, state, attempts, error, accepted FROM g")
def lifecycle_stream(spark, sf_dir):
    """The control events through the streaming lifecycle: a file stream into a table, until nothing is left."""
    from casebook.streaming import lifecycle_stream as stream

    root = f"{spark.conf.get('spark.checkpoint.dir', 'file:/tmp/casebook-shared').rstrip('/')}/lifecycle-{uuid.uuid4().hex}"
    events = _control(spark, sf_dir).select(F.col("record").cast("string").alias("record"), "at", "seq", "event")
    events.write.parquet(f"{root}/events")
    source = spark.readStream.schema(events.schema).parquet(f"{root}/events")
    stream.to_table(stream.lifecycle(source), f"{root}/outcomes", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/outcomes")


# ---- matching

@query("patient_candidates", """WITH c AS (SELECT DISTINCT upper(regexp_replace(c_name, '\\s+', '', 'g')) AS code FROM customer), k AS (SELECT DISTINCT upper(regexp_replace(c_name, '\\s+', '', 'g')) AS candidate FROM customer)
SELECT code, candidate, damerau_levenshtein(code, candidate)::INT AS distance, row_number() OVER (PARTITION BY code ORDER BY damerau_levenshtein(code, candidate), candidate)::INT AS place
FROM c JOIN k ON abs(length(code) - length(candidate)) <= 1 AND damerau_levenshtein(code, candidate) <= 1""")
def patient_candidates(spark, sf_dir):
    codes = table(spark, sf_dir, "customer").select(F.col("c_name").alias("code"))
    return match.code_candidates(codes, codes)


@query("patient_view", """SELECT c_custkey AS code, count(o_orderkey)::BIGINT AS visits, max(o_orderdate) AS last_visit FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def patient_view(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    links = orders.select(F.col("o_custkey").alias("code"), F.col("o_orderkey").alias("record_id"))
    return records.patient_view(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("code")), links, orders.select(F.col("o_orderkey").alias("record_id"), F.col("o_orderdate").alias("captured_at")))


@query("patient_search", "SELECT o_custkey AS code, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS pages FROM orders GROUP BY 1")
def patient_search(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return records.patient_pages(orders.select(F.col("o_custkey").alias("code"), F.col("o_orderkey").alias("record_id")), orders.select(F.col("o_orderkey").alias("record_id"), F.col("o_orderpriority").alias("page_type")))


_TOKENS = "SELECT DISTINCT doc_id AS page, lang AS page_type, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS label FROM documents"
_INDEX = f"""t AS ({_TOKENS}), o AS (SELECT page_type, label, count(*) AS copies FROM t GROUP BY ALL), n AS (SELECT count(DISTINCT page_type) AS n FROM o), d AS (SELECT label, count(*) AS df FROM o GROUP BY 1),
i AS (SELECT page_type, label, copies, df, ln(1 + n / df) AS idf FROM o JOIN d USING (label), n WHERE length(label) >= 4)"""


def _tokens(spark, sf_dir) -> DataFrame:
    """(page, page_type, label): the distinct words of each document. Every use is the same plan, so its exchange is reused."""
    words = F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("label")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), F.col("lang").alias("page_type"), words).distinct()


@query("label_idf", f'WITH {_INDEX} SELECT page_type, label, copies::BIGINT AS copies, df::BIGINT AS df, idf, copies = 1 AS "unique" FROM i')
def label_idf(spark, sf_dir):
    return match.label_index(_tokens(spark, sf_dir).select("page_type", "label"))


_SEEN = "SELECT page, label, CASE page % 10 WHEN 0 THEN 70.0 ELSE 80.0 + (page + length(label)) % 21 END AS best FROM t"


@query("page_classify", f"""WITH {_INDEX}, tot AS (SELECT page_type, sum(idf * copies) AS total FROM i GROUP BY 1), s AS ({_SEEN}), h AS (SELECT page, page_type, sum(idf * copies * best / 100) AS got FROM s JOIN i USING (label) WHERE best >= 80 GROUP BY ALL),
g AS (SELECT page, page_type, round(got / total, 9) AS score FROM h JOIN tot USING (page_type)),
r AS (SELECT *, row_number() OVER w AS rank, score - coalesce(lead(score) OVER w, 0) AS margin FROM g WINDOW w AS (PARTITION BY page ORDER BY score DESC, page_type))
SELECT p.page, page_type, round(coalesce(score, 0), 6) AS score, round(coalesce(margin, 0), 6) AS margin, CASE WHEN coalesce(score, 0) < 0.15 THEN 'none' WHEN margin < 0.08 THEN 'close' ELSE 'clear' END AS verdict FROM (SELECT DISTINCT page FROM t) p LEFT JOIN (SELECT * FROM r WHERE rank = 1) b USING (page)""")
def page_classify(spark, sf_dir):
    tokens = _tokens(spark, sf_dir)
    likeness = F.when(F.col("page") % 10 == 0, 70.0).otherwise(80.0 + (F.col("page") + F.char_length("label")) % 21)
    rows = match.classify(tokens.select("page_type", "label"), tokens.select("page", "label", likeness.alias("similarity")))
    return rows.select("page", "page_type", F.round("score", 6).alias("score"), F.round("margin", 6).alias("margin"), "verdict")


# ---- decisions over lineitem rows standing in for fields

_FIELD_SQL = """SELECT l_orderkey AS page, l_linenumber AS ord, l_discount * 10 AS conf, CASE WHEN l_discount < 0.03 THEN 'NEEDS_REVIEW' WHEN l_tax > 0.06 THEN 'ILLEGIBLE' ELSE 'KNOWN' END AS status,
  l_linestatus AS kind, l_returnflag AS page_type FROM lineitem"""


def _fields(spark, sf_dir) -> DataFrame:
    status = F.when(F.col("l_discount") < 0.03, "NEEDS_REVIEW").when(F.col("l_tax") > 0.06, "ILLEGIBLE").otherwise("KNOWN")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("ord"), (F.col("l_discount") * 10).alias("conf"), status.alias("status"), F.col("l_linestatus").alias("kind"), F.col("l_returnflag").alias("page_type"))


@query("review_queue", f"SELECT page, ord, status, row_number() OVER (PARTITION BY page ORDER BY conf, ord, ord)::INT AS rank FROM ({_FIELD_SQL}) WHERE status IN ('NEEDS_REVIEW', 'ILLEGIBLE')")
def review_queue(spark, sf_dir):
    return decide.review_queue(_fields(spark, sf_dir).withColumn("confidence", F.col("conf")).withColumn("key", F.col("ord"))).select("page", "ord", "status", "rank")


@query("status_summary", f"SELECT page, status, count(*)::BIGINT AS n FROM ({_FIELD_SQL}) GROUP BY 1, 2")
def status_summary(spark, sf_dir):
    return decide.status_summary(_fields(spark, sf_dir))


_TEXTS = """SELECT l_orderkey, l_linenumber, l_discount * 10 AS ocr, CASE l_suppkey % 5 WHEN 0 THEN 0.0 WHEN 1 THEN 0.5 ELSE 1 - l_tax END AS page, l_quantity::INT % 9 AS k FROM lineitem"""


@query("decide_text", f"""WITH r AS ({_TEXTS}), c AS (SELECT *, CASE k WHEN 3 THEN (0.5 + 0.5 * ocr) * page WHEN 4 THEN ocr * page * (0.6 + 0.4 * 0.7) ELSE ocr * page END AS conf FROM r),
d AS (SELECT *, CASE WHEN k = 0 THEN 0 WHEN k IN (1, 8) THEN 1 WHEN k = 7 THEN 2 WHEN k = 2 THEN 3 WHEN ocr < 0.35 THEN 4 WHEN k = 5 THEN 5 WHEN k = 6 THEN 6 WHEN conf < 0.8 THEN 7 ELSE 8 END AS rung FROM c)
SELECT l_orderkey, l_linenumber, ['NOT_PROVIDED', 'NOT_APPLICABLE', 'NOT_APPLICABLE', 'UNKNOWN', 'ILLEGIBLE', 'NEEDS_REVIEW', 'NEEDS_REVIEW', 'NEEDS_REVIEW', 'KNOWN'][rung + 1] AS status,
 round(least(1, greatest(0, CASE rung WHEN 0 THEN 0.97 * page WHEN 1 THEN 0.9 * page WHEN 2 THEN 0.9 * page WHEN 3 THEN ocr * page WHEN 4 THEN 0.3 * page WHEN 5 THEN 0.5 * ocr * page WHEN 6 THEN least(conf, 0.5) ELSE conf END)), 6) AS confidence,
 CASE rung WHEN 4 THEN 'handwriting could not be read' WHEN 5 THEN 'no value' WHEN 6 THEN 'odd' WHEN 7 THEN 'low reading confidence' ELSE '' END AS issues FROM d""")
def decide_text(spark, sf_dir):
    from casebook.functions.parse import PARSED

    sup = F.col("l_suppkey") % 5
    page = F.when(sup == 0, 0.0).when(sup == 1, 0.5).otherwise(1 - F.col("l_tax"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("ocr"), page.alias("page"), (F.col("l_quantity").cast("int") % 9).alias("k"))
    k, texts = F.col("k"), lambda *t: F.array(*map(F.lit, t)).cast("array<string>")
    issues = F.when(k == 5, texts("no value")).when(k == 6, texts("odd")).otherwise(texts())
    marker = F.when(k == 1, "dash").when(k == 2, "unknown").when(k == 7, "not_done")
    parsed = F.struct(F.lit("x").alias("value"), F.lit(None).cast("double").alias("n"), F.lit("x").alias("display"), (k != 5).alias("ok"), issues.alias("issues"), marker.alias("marker"), F.when(k == 4, 0.7).otherwise(1.0).alias("snapped")).cast(PARSED)
    r = {"ink": k != 0, "fraction": F.lit(0.0), "dash": k == 8, "text": F.lit("x"), "ocr": F.col("ocr"), "page": F.col("page"), "dtype": F.when(k == 3, "sex").otherwise("str"), "threshold": decide.known_threshold(F.lit(1000)), "parsed": parsed}
    d = decide.text_decision(r)
    return rows.select("l_orderkey", "l_linenumber", d.alias("d")).select("l_orderkey", "l_linenumber", "d.status", F.round("d.confidence", 6).alias("confidence"), F.array_join("d.issues", ",").alias("issues"))


@query("decide_check", """WITH c AS (SELECT l_orderkey, l_linenumber, l_tax AS score, least(1, greatest(0, 0.5 + abs(l_tax - 0.07) / 0.12)) * (1 - l_discount) AS conf FROM lineitem)
SELECT l_orderkey, l_linenumber, score >= 0.07 AS value, CASE WHEN conf < 0.65 THEN 'NEEDS_REVIEW' ELSE 'KNOWN' END AS status, round(conf, 6) AS confidence FROM c""")
def decide_check(spark, sf_dir):
    d = decide.check_decision(F.col("l_tax"), 1 - F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", d["value"].alias("value"), d["status"].alias("status"), F.round(d["confidence"], 6).alias("confidence"))


@query("decide_radio", """WITH c AS (SELECT l_orderkey, l_linenumber, l_tax, least(1, greatest(0, 0.5 + abs(l_tax - 0.07) / 0.12)) AS conf FROM lineitem),
g AS (SELECT l_orderkey, count(*) FILTER (WHERE l_tax >= 0.07) AS n, arg_max(l_linenumber, {'a': l_tax, 'b': l_linenumber}) AS best, min(conf) AS least_ FROM c GROUP BY 1)
SELECT l_orderkey, CASE WHEN n > 0 THEN best END AS value, CASE WHEN n = 0 THEN 'NOT_PROVIDED' WHEN n > 1 OR least_ < 0.65 THEN 'NEEDS_REVIEW' ELSE 'KNOWN' END AS status, round(CASE WHEN n > 1 THEN least(least_, 0.5) ELSE least_ END, 6) AS confidence FROM g""")
def decide_radio(spark, sf_dir):
    options = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("option"), F.col("l_tax").alias("score"), F.lit(1.0).alias("page"))
    return decide.radio_decision(options, ["l_orderkey"]).withColumn("confidence", F.round("confidence", 6))


_OPINIONS = """SELECT l_orderkey AS crop, l_partkey * 10 + l_linenumber AS source, l_linenumber % 3 AS origin, CAST(CAST(l_quantity AS INT) % 4 AS VARCHAR) AS text, CAST(l_partkey % 3 AS VARCHAR) AS value, l_suppkey % 4 > 0 AS ok, CASE WHEN l_suppkey % 7 = 0 THEN 'dash' END AS marker,
 CASE WHEN l_suppkey % 3 = 0 THEN 1 ELSE 0 END AS issues, l_partkey % 2 = 0 AS plausible, CASE WHEN l_partkey % 5 = 0 THEN 0.75 ELSE 1.0 END AS snapped, l_discount * 10 AS score FROM lineitem"""


@query("choose_reading", f"""WITH r AS ({_OPINIONS}),
j AS (SELECT a.crop, a.source, a.value, a.marker, a.ok, a.issues, a.plausible, a.snapped, a.score, count(*) FILTER (WHERE a.origin <> b.origin AND (a.text = b.text OR (a.ok AND b.ok AND a.marker IS NOT DISTINCT FROM b.marker AND (a.marker IS NOT NULL OR a.value = b.value)))) AS agreement,
 max(b.score) FILTER (WHERE a.text = b.text OR (b.ok AND a.value = b.value)) AS base FROM r a JOIN r b ON a.crop = b.crop GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY crop ORDER BY agreement DESC, (ok AND issues = 0) DESC, plausible DESC, snapped DESC, score DESC, source, value DESC) AS n FROM j)
SELECT crop, source, value, agreement::BIGINT AS agreement, round(CASE WHEN agreement > 0 THEN 0.55 + 0.45 * base ELSE 0.75 * score END * CASE WHEN snapped < 1 THEN 0.6 + 0.4 * snapped ELSE 1 END, 6) AS confidence FROM n WHERE n = 1""")
def choose_reading(spark, sf_dir):
    l = lambda c: F.col(f"l_{c}")  # noqa: E731, E741
    readings = table(spark, sf_dir, "lineitem").select(
        l("orderkey").alias("crop"), (l("partkey") * 10 + l("linenumber")).alias("source"), (l("linenumber") % 3).alias("origin"), (l("quantity").cast("int") % 4).cast("string").alias("text"), (l("partkey") % 3).cast("string").alias("value"), (l("suppkey") % 4 > 0).alias("ok"), F.when(l("suppkey") % 7 == 0, "dash").alias("marker"),
        F.when(l("suppkey") % 3 == 0, 1).otherwise(0).alias("issues"), (l("partkey") % 2 == 0).alias("plausible"), F.when(l("partkey") % 5 == 0, 0.75).otherwise(1.0).alias("snapped"), (l("discount") * 10).alias("score"))
    return decide.choose_reading(readings).withColumn("confidence", F.round("confidence", 6))


# ---- rules: orders are visits of customers

_PAGES_SQL = """SELECT o_custkey AS page, min(o_orderdate)::DATE AS lmp, (min(o_orderdate)::DATE + 270 + (o_custkey % 21)::INT) AS edd, (min(o_orderdate)::DATE + 278 + (o_custkey % 17)::INT) AS post_term,
 o_custkey % 5 AS gravidity, o_custkey % 7 AS parity, o_custkey % 11 AS living, 30 + o_custkey % 12 AS ga_birth, 1000 + o_custkey % 2500 AS weight FROM orders GROUP BY o_custkey"""


def _pages(spark, sf_dir) -> DataFrame:
    k = F.col("page")
    first = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("page")).agg(F.min("o_orderdate").cast("date").alias("lmp"))
    day = lambda n: F.date_add("lmp", n.cast("int"))
    return first.select("page", "lmp", day(k % 21 + 270).alias("edd"), day(k % 17 + 278).alias("post_term"), (k % 5).alias("gravidity"), (k % 7).alias("parity"), (k % 11).alias("living"), (k % 12 + 30).alias("ga_birth"), (k % 2500 + 1000).alias("weight"))


def _rule(name: str, f, where: str, keys: list[str], issue: str, order: int) -> None:
    one = " UNION ALL ".join(f"SELECT page, '{k}' AS key, '{issue}' AS issue, 0.6 AS cap, {order} AS ord FROM p WHERE {where}" for k in keys)
    query(name, f"WITH p AS ({_PAGES_SQL}) {one}")(lambda spark, sf_dir: f(_pages(spark, sf_dir)))


_rule("rule_edd", rules.due_date, "abs(date_diff('day', lmp, edd) - 280) > 3", ["lmp_date", "expected_delivery_date"], "due date should be last period + 280 days", 3)
_rule("rule_post_term", rules.post_term, "abs(date_diff('day', edd, post_term) - 7) > 2", ["expected_delivery_date", "term_exceeded_date"], "post-term date should be due date + 7 days", 4)
_rule("rule_parity", rules.parity, "parity > gravidity", ["gravidity", "parity"], "parity cannot exceed gravidity", 8)
_rule("rule_living", rules.living, "living > parity + 2", ["parity", "living_children"], "more living children than deliveries", 9)
_rule("rule_term_weight", rules.term_weight, "ga_birth >= 37 AND weight < 1500", ["birth_weight_g"], "very low weight for a term birth", 10)


@query("rule_visits", f"""WITH p AS ({_PAGES_SQL}), v AS (SELECT o_custkey AS page, o_orderkey AS ord, CASE WHEN o_orderkey % 6 > 0 THEN o_orderdate::DATE END AS seen, (o_orderkey % 40)::DOUBLE AS ga FROM orders),
w AS (SELECT *, last_value(seen IGNORE NULLS) OVER (PARTITION BY page ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM v)
SELECT w.page, ord, seen, coalesce(NOT (seen > lmp AND seen <= edd + 30), false) AS outside, coalesce(abs(date_diff('day', lmp, seen) / 7 - ga) > 2.5, false) AS weeks_differ, coalesce(seen < before, false) AS goes_back FROM w LEFT JOIN p USING (page)""")
def rule_visits(spark, sf_dir):
    visits = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderkey") % 6 > 0, F.col("o_orderdate").cast("date")).alias("seen"), (F.col("o_orderkey") % 40).cast("double").alias("ga"))
    return rules.visit_checks(visits, _pages(spark, sf_dir))


_VISITS_SQL = f"""v AS (SELECT o_custkey AS page, o_orderkey AS ord, 'v' || (o_orderkey % 97) AS visit, CASE WHEN o_orderkey % 6 > 0 THEN o_orderdate::DATE END AS seen, (o_orderkey % 40)::DOUBLE AS ga, CASE WHEN o_orderkey % 4 > 0 THEN o_orderdate::DATE - 30 END AS appointment FROM orders),
w AS (SELECT v.*, last_value(seen IGNORE NULLS) OVER (PARTITION BY page ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM v), x AS (SELECT w.*, lmp, edd + 30 AS last_day FROM w JOIN p USING (page))"""
_FLAGS_SQL = f"""WITH p AS ({_PAGES_SQL}), {_VISITS_SQL}, f AS (
 SELECT page, 'record_number' AS key, 'patient code: confirm before linking the visit' AS issue, 0.79 AS cap, 1 AS ord FROM p
 UNION ALL SELECT page, k, 'facility name and ticked facility type disagree', 0.6, 2 FROM p, (VALUES ('facility_name'), ('facility_type')) z(k) WHERE page % 4 > 0 AND (['DR', 'CSC', 'XX'])[1 + page % 3] IN ('DR', 'CSC') AND (['DR', 'CSC', 'XX'])[1 + page % 3] <> (['DR', 'CSU'])[1 + page % 2]
 UNION ALL SELECT page, k, 'due date should be last period + 280 days', 0.6, 3 FROM p, (VALUES ('lmp_date'), ('expected_delivery_date')) z(k) WHERE abs(date_diff('day', lmp, edd) - 280) > 3
 UNION ALL SELECT page, k, 'post-term date should be due date + 7 days', 0.6, 4 FROM p, (VALUES ('expected_delivery_date'), ('term_exceeded_date')) z(k) WHERE abs(date_diff('day', edd, post_term) - 7) > 2
 UNION ALL SELECT page, 'visits.' || visit || '.appointment_date', 'date outside this pregnancy (last period → due date)', 0.6, 5 FROM x WHERE NOT (appointment > lmp AND appointment <= last_day)
 UNION ALL SELECT page, 'visits.' || visit || '.attended_date', 'date outside this pregnancy (last period → due date)', 0.6, 5 FROM x WHERE NOT (seen > lmp AND seen <= last_day)
 UNION ALL SELECT page, 'visits.' || visit || '.gestational_age_weeks', 'does not match visit date (' || printf('%.0f', round(date_diff('day', lmp, seen) / 7.0::DOUBLE)) || ' SA expected)', 0.6, 6 FROM x WHERE abs(date_diff('day', lmp, seen) / 7.0::DOUBLE - ga) > 2.5
 UNION ALL SELECT page, 'visits.' || visit || '.attended_date', 'earlier than the previous visit', 0.6, 7 FROM x WHERE seen < before
 UNION ALL SELECT page, k, 'parity cannot exceed gravidity', 0.6, 8 FROM p, (VALUES ('gravidity'), ('parity')) z(k) WHERE parity > gravidity
 UNION ALL SELECT page, k, 'more living children than deliveries', 0.6, 9 FROM p, (VALUES ('parity'), ('living_children')) z(k) WHERE living > parity + 2
 UNION ALL SELECT page, 'birth_weight_g', 'very low weight for a term birth', 0.6, 10 FROM p WHERE ga_birth >= 37 AND weight < 1500)"""


def _all_flags(spark, sf_dir) -> DataFrame:
    k = F.col("page")
    pick = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (n + 1).cast("int"))
    pages = _pages(spark, sf_dir).withColumns({"name_prefix": pick(["DR", "CSC", "XX"], k % 3), "type": pick(["DR", "CSU"], k % 2), "type_status": F.when(k % 4 > 0, "KNOWN").otherwise("NEEDS_REVIEW")})
    o = F.col("o_orderkey")
    day = F.col("o_orderdate").cast("date")
    visits = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page"), o.alias("ord"), F.concat(F.lit("v"), o % 97).alias("visit"), F.when(o % 6 > 0, day).alias("seen"), (o % 40).cast("double").alias("ga"), F.when(o % 4 > 0, F.date_sub(day, 30)).alias("appointment"))
    linking = pages.select("page", F.lit("record_number").alias("key"), F.lit(True).alias("linking"))
    return rules.all_flags(linking, pages, visits)


@query("rules_all", f"{_FLAGS_SQL} SELECT page, key, issue, cap::DOUBLE AS cap, ord FROM f")
def rules_all(spark, sf_dir):
    return _all_flags(spark, sf_dir)


@query("rules_applied", f"""{_FLAGS_SQL}, k AS (SELECT page, key, row_number() OVER (PARTITION BY page ORDER BY key) AS n FROM (SELECT DISTINCT page, key FROM f)),
s AS (SELECT page, key, CASE n % 4 WHEN 0 THEN 'NOT_PROVIDED' WHEN 1 THEN 'NEEDS_REVIEW' ELSE 'KNOWN' END AS status, CASE n % 3 WHEN 0 THEN 0.4 ELSE 0.95 END AS confidence FROM k),
g AS (SELECT page, key, string_agg(issue, ';' ORDER BY ord, issue) AS issues, min(cap) AS cap FROM f GROUP BY ALL)
SELECT page, key, CASE WHEN status = 'NOT_PROVIDED' THEN status ELSE 'NEEDS_REVIEW' END AS status, CASE WHEN status = 'NOT_PROVIDED' THEN confidence ELSE least(confidence, cap) END::DOUBLE AS confidence, CASE WHEN status = 'NOT_PROVIDED' THEN 'read' ELSE 'read;' || issues END AS issues FROM s JOIN g USING (page, key)""")
def rules_applied(spark, sf_dir):
    """All ten rules folded back onto the fields that they concern."""
    from pyspark.sql import Window

    from casebook.plans.rules_union import apply_flags

    flags = _all_flags(spark, sf_dir)
    n = F.row_number().over(Window.partitionBy("page").orderBy("key"))
    fields = flags.select("page", "key").distinct().withColumn("n", n).select("page", "key", F.when(F.col("n") % 4 == 0, "NOT_PROVIDED").when(F.col("n") % 4 == 1, "NEEDS_REVIEW").otherwise("KNOWN").alias("status"), F.when(F.col("n") % 3 == 0, 0.4).otherwise(0.95).alias("confidence"), F.array(F.lit("read")).alias("issues"))
    return apply_flags(fields, flags).select("page", "key", "status", "confidence", F.array_join("issues", ";").alias("issues"))


# ---- layout joins

@query("table_expand", """SELECT 't.' || c || '.' || r AS key, coalesce(cd, rd) AS dtype, CASE WHEN lead(c) OVER w IS NOT NULL THEN 't.' || lead(c) OVER w || '.' || r END AS next_key
FROM (VALUES ('date', 'date'), ('weight', 'kg'), ('bp', 'bp')) a(r, rd), (VALUES ('v1', NULL, 1), ('v2', 'str', 2), ('v3', NULL, 3)) b(c, cd, co) WINDOW w AS (PARTITION BY r ORDER BY co)""")
def table_expand(spark, sf_dir):
    rows = spark.createDataFrame([("date", "date"), ("weight", "kg"), ("bp", "bp")], "row string, row_dtype string")
    cols = spark.createDataFrame([("v1", None, 1), ("v2", "str", 2), ("v3", None, 3)], "col string, col_dtype string, col_ord int")
    return records.expand_table(rows, cols, "t")


@query("point_in_region", """WITH pt AS (SELECT p_partkey AS point, p_retailprice AS x, p_size AS y FROM part), r AS (SELECT n_nationkey AS region, n_nationkey * 60.0 AS x0, n_nationkey * 60.0 + 400 AS x1, n_nationkey AS y0, n_nationkey + 25 AS y1 FROM nation)
SELECT point, arg_min(region, region) AS region FROM pt JOIN r ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY point""")
def point_in_region(spark, sf_dir):
    n = F.col("n_nationkey")
    regions = table(spark, sf_dir, "nation").select(n.alias("region"), (n * 60.0).alias("x0"), (n * 60.0 + 400).alias("x1"), n.alias("y0"), (n + 25).alias("y1"), n.alias("ord"))
    return geometry.point_in_region(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("point"), F.col("p_retailprice").alias("x"), F.col("p_size").alias("y")), regions)


@query("nearest_box", """WITH l AS (SELECT s_suppkey AS label, s_acctbal AS lx1, s_suppkey % 50 AS ly FROM supplier), b AS (SELECT n_nationkey AS box, n_nationkey * 400.0 AS bx, n_nationkey * 2 AS by_ FROM nation)
SELECT label, box, gap FROM (SELECT label, box, bx - lx1 AS gap, row_number() OVER (PARTITION BY label ORDER BY abs(bx - lx1), box) AS n FROM l JOIN b ON abs(by_ - ly) <= 7 AND bx - lx1 BETWEEN -2 AND 80) WHERE n = 1""")
def nearest_box(spark, sf_dir):
    labels = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("label"), F.col("s_acctbal").alias("lx1"), (F.col("s_suppkey") % 50).alias("ly"))
    boxes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("box"), (F.col("n_nationkey") * 400.0).alias("bx"), (F.col("n_nationkey") * 2).alias("by"))
    return geometry.nearest_on_line(labels, boxes)


@query("next_label_stop", "SELECT l_orderkey AS line, l_linenumber AS mark, l_quantity AS x, lead(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber, l_partkey) AS stop, l_partkey AS part FROM lineitem")
def next_label_stop(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("line"), F.col("l_linenumber").alias("mark"), F.col("l_quantity").alias("x"), F.col("l_partkey").alias("part"))
    return geometry.next_stop(rows.withColumn("mark", F.struct("mark", "part"))).withColumn("mark", F.col("mark.mark"))


@query("run_groups", "SELECT line, run, g FROM (SELECT user_id AS line, event_id AS run, sum(far) OVER (PARTITION BY user_id ORDER BY value, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS g FROM (SELECT *, CASE WHEN value - lag(value) OVER (PARTITION BY user_id ORDER BY value, event_id) > 5 OR lag(value) OVER (PARTITION BY user_id ORDER BY value, event_id) IS NULL THEN 1 ELSE 0 END AS far FROM events))")
def run_groups(spark, sf_dir):
    return geometry.sessions(table(spark, sf_dir, "events").select(F.col("user_id").alias("line"), F.col("event_id").alias("run"), F.col("value").alias("x")), 5.0).select("line", "run", F.col("group").alias("g"))


@query("near_top_labels", """WITH f AS (SELECT l_orderkey AS label, l_linenumber AS id, l_quantity AS score, l_partkey AS x, l_suppkey AS y, max(l_quantity) OVER (PARTITION BY l_orderkey) AS top FROM lineitem)
SELECT label, id, row_number() OVER (PARTITION BY label ORDER BY round(y / 12), x, id)::INT AS place FROM f WHERE score >= top - 5""")
def near_top_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("label"), F.col("l_linenumber").alias("id"), F.col("l_quantity").alias("score"), F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y"))
    return geometry.near_top_labels(rows).select("label", "id", "place")


@query("median_height", "SELECT o_orderpriority AS layout, round(median(o_totalprice), 4) AS height FROM orders GROUP BY 1")
def median_height(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("layout")).agg(F.round(F.median("o_totalprice"), 4).alias("height"))


# ---- evaluation

_EVAL = """SELECT (['text', 'cell', 'check', 'radio'])[1 + l_suppkey % 4] AS kind, l_returnflag AS page_type, CASE WHEN l_tax < 0.06 THEN 'KNOWN' ELSE 'NOT_PROVIDED' END AS gt_status,
 CASE WHEN l_discount < 0.03 THEN 'NEEDS_REVIEW' WHEN l_discount > 0.08 THEN 'ILLEGIBLE' WHEN l_tax < 0.07 THEN 'KNOWN' ELSE 'NOT_PROVIDED' END AS pred_status, l_quantity > 5 AS value_ok, l_discount * 10 AS conf, l_orderkey, l_linenumber FROM lineitem"""
_PRED = "CASE WHEN l_discount < 0.03D THEN 'NEEDS_REVIEW' WHEN l_discount > 0.08D THEN 'ILLEGIBLE' WHEN l_tax < 0.07D THEN 'KNOWN' ELSE 'NOT_PROVIDED' END AS pred_status"


def _eval(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("element_at(array('text', 'cell', 'check', 'radio'), int(1 + l_suppkey % 4)) AS kind", "l_returnflag AS page_type", "CASE WHEN l_tax < 0.06D THEN 'KNOWN' ELSE 'NOT_PROVIDED' END AS gt_status", _PRED, "l_quantity > 5 AS value_ok", "l_discount * 10 AS conf")
    return rows.withColumn("status_ok", F.col("gt_status") == F.col("pred_status"))


@query("eval_metrics_grouping_sets", f"""WITH e AS (SELECT *, gt_status = pred_status AS status_ok FROM ({_EVAL}))
SELECT kind, page_type, GROUPING(kind, page_type)::BIGINT AS level, count(*)::BIGINT AS fields, round(count(*) FILTER (WHERE value_ok AND status_ok) / count(*), 4) AS field_accuracy,
 round(count(*) FILTER (WHERE value_ok AND gt_status = 'KNOWN') / nullif(count(*) FILTER (WHERE gt_status = 'KNOWN'), 0), 4) AS value_accuracy, round(count(*) FILTER (WHERE status_ok) / count(*), 4) AS status_accuracy,
 round(count(*) FILTER (WHERE pred_status IN ('NEEDS_REVIEW', 'ILLEGIBLE') AND gt_status = 'KNOWN') / nullif(count(*) FILTER (WHERE gt_status = 'KNOWN'), 0), 4) AS review_rate,
 round(count(*) FILTER (WHERE pred_status = 'KNOWN' AND NOT (value_ok AND status_ok)) / nullif(count(*) FILTER (WHERE pred_status = 'KNOWN'), 0), 4) AS silent_rate,
 (count(*) FILTER (WHERE pred_status = 'KNOWN' AND NOT (value_ok AND status_ok)))::BIGINT AS silent FROM e GROUP BY GROUPING SETS ((), (kind), (page_type))""")
def eval_metrics(spark, sf_dir):
    return evaluate.metrics(_eval(spark, sf_dir))


@query("calibration", f"SELECT least(9, floor(conf * 10))::INT AS bin, count(*)::BIGINT AS n, round(avg(value_ok::INT), 3) AS accuracy FROM ({_EVAL}) WHERE gt_status = 'KNOWN' AND kind IN ('text', 'cell') GROUP BY 1")
def calibration(spark, sf_dir):
    return evaluate.calibration(_eval(spark, sf_dir))


@query("eval_rows_join", """SELECT d.doc_id AS page, 'toxic' AS key, lang AS kind, source AS page_type, 'KNOWN' AS gt_status, CASE WHEN l.doc_id IS NULL THEN 'MISSING' ELSE 'KNOWN' END AS pred_status, l.doc_id IS NOT NULL AS status_ok,
 coalesce((d.n_chars % 2)::VARCHAR = l.toxic::VARCHAR, false) AS value_ok, coalesce(l.quality::DOUBLE, 0) AS conf FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def eval_rows_join(spark, sf_dir):
    truth = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), F.lit("toxic").alias("key"), F.col("lang").alias("kind"), F.col("source").alias("page_type"), F.lit("KNOWN").alias("gt_status"), (F.col("n_chars") % 2).cast("string").alias("gt_value"))
    got = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page"), F.lit("toxic").alias("key"), F.lit("KNOWN").alias("pred_status"), F.col("toxic").cast("string").alias("pred_value"), F.col("quality").cast("double").alias("conf"))
    return evaluate.eval_rows(truth, got)


@query("priors_words", """WITH n AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2) SELECT p_brand, p_type, n::BIGINT AS n, round(ln((n + 1) / (sum(n) OVER (PARTITION BY p_brand) + count(*) OVER (PARTITION BY p_brand))), 9) AS prior FROM n""")
def priors_words(spark, sf_dir):
    return decode.word_priors(table(spark, sf_dir, "part"), "p_brand", "p_type").withColumn("prior", F.round("prior", 9))


@query("priors_numbers", "SELECT o_orderpriority, count(o_totalprice)::BIGINT AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS sd FROM orders GROUP BY 1")
def priors_numbers(spark, sf_dir):
    return evaluate.number_priors(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice").withColumns({"mean": F.round("mean", 4), "sd": F.round("sd", 4)})


ALT_TRUTH = [("a", "k1", "12", None, None), ("a", "k2", "x", ["y"], ["k9"]), ("a", "k3", "z", None, ["k8"]), ("b", "k1", "1", ["l"], None), ("b", "k2", "2", None, ["k1"])]
ALT_GOT = [("a", "k1", "12"), ("a", "k9", "y"), ("a", "k8", "q"), ("b", "k1", "l"), ("b", "k7", "2")]


@query("alt_key_match", "SELECT * FROM (VALUES ('a', 'k1', true), ('a', 'k2', true), ('a', 'k3', false), ('b', 'k1', true), ('b', 'k2', false)) v(photo, key, hit)")
def alt_key_match(spark, sf_dir):
    truth = spark.createDataFrame(ALT_TRUTH, "photo string, key string, value string, accept array<string>, alt array<string>")
    return evaluate.alternative_match(truth, spark.createDataFrame(ALT_GOT, "photo string, key string, value string"))


# ---- decoding

_BP_PRIORS = {"blood_pressure": [(11.5, 1.2), (7.25, 0.9)]}
_BP_LAW = "-0.5 * power((s - 11.5) / (1.5::DOUBLE * 1.2), 2) + -0.5 * power((d - 7.25) / (1.5::DOUBLE * 0.9), 2)"


@query("candidate_grid_bp", f"""WITH c AS (SELECT s::DOUBLE AS s, d::DOUBLE AS d, s || '/' || d AS text, s || '/' || d AS value FROM range(7, 23) a(s), range(4, 14) b(d) WHERE d < s
 UNION ALL SELECT s, d, s * 10 || '/' || d * 10, s || '/' || d FROM range(7, 23) a(s), range(4, 14) b(d) WHERE d < s
 UNION ALL SELECT s / 10, d / 10, s || '/' || d, printf('%g', s / 10) || '/' || printf('%g', d / 10) FROM range(80, 200) a(s), range(40, 130) b(d) WHERE d + 10 <= s AND (s % 10 <> 0 OR d % 10 <> 0))
SELECT text, min(value) AS value, round({_BP_LAW}, 6) AS prior FROM c GROUP BY text, s, d""")
def candidate_grid_bp(spark, sf_dir):
    return decode.candidates(spark, "blood_pressure", "bp", priors=_BP_PRIORS).withColumn("prior", F.round("prior", 6))


@query("candidate_dates", """WITH d AS (SELECT unnest(generate_series(DATE '2020-01-01', DATE '2025-12-31', INTERVAL 1 DAY))::DATE AS d)
SELECT DISTINCT unnest([strftime(d, '%-d/%-m/%y'), strftime(d, '%d/%m/%y'), strftime(d, '%-d/%-m/%Y'), strftime(d, '%d/%m/%Y'), strftime(d, '%d/%-m/%y'), strftime(d, '%-d/%m/%y')]) AS text, strftime(d, '%Y-%m-%d') AS value,
 CASE WHEN date_diff('day', d, DATE '2024-06-01') BETWEEN 0 AND 730 THEN 0.0::DOUBLE ELSE -3.0::DOUBLE END AS prior FROM d""")
def candidate_dates(spark, sf_dir):
    return decode.candidates(spark, "lmp_date", "date", as_of="2024-06-01")


@query("candidate_weeks", """WITH w AS (SELECT w, -0.5 * power((w - 30) / (1.5::DOUBLE * 6), 2) AS p FROM range(20, 46) a(w))
SELECT w || 'SA' AS text, w::VARCHAR AS value, round(p, 6) + 0 AS prior FROM w UNION ALL SELECT w::VARCHAR, w::VARCHAR, round(p - 1, 6) FROM w
UNION ALL SELECT unnest([w || 'SA+' || d || 'j', w || 'SA+' || d, w || 'SA' || d || 'j']), w || '+' || d, round(p, 6) + 0 FROM w, range(0, 7) b(d)""")
def candidate_weeks(spark, sf_dir):
    return decode.candidates(spark, "gestational_age_weeks", "weeks", 20, 45, priors={"gestational_age_weeks": [(30, 6)]}).withColumn("prior", F.round("prior", 6) + 0.0)


@query("candidate_numbers", """WITH n AS (SELECT n FROM range(30, 161) a(n)), k AS (SELECT n || u AS text, n::VARCHAR AS value FROM n, (VALUES (''), ('kg')) b(u) UNION ALL SELECT n || s || t, n || '.' || t FROM n, range(0, 10) b(t), (VALUES (','), ('.')) c(s) UNION ALL SELECT 'NF', 'NF'),
g AS (SELECT a + b / 100 AS v, a, b FROM range(0, 5) x(a), range(0, 100) y(b)), f AS (SELECT a || s || lpad(b::VARCHAR, 2, '0') AS text, printf('%g', v) AS value, 0.0 AS prior FROM g, (VALUES (','), ('.')) c(s) WHERE v BETWEEN 0.4 AND 4 UNION ALL SELECT a || s || b // 10, printf('%g', v), 0.0 FROM g, (VALUES (','), ('.')) c(s) WHERE v BETWEEN 0.4 AND 4 AND b % 10 = 0 UNION ALL SELECT a::VARCHAR, a::VARCHAR, -0.5 FROM range(0, 5) x(a)),
h AS (SELECT n || u AS text, n || '000' AS value FROM range(80, 600) a(n), (VALUES ('000'), ('000/mm3'), ('k')) b(u))
SELECT 'kg' AS kind, text, value, 0.0::DOUBLE AS prior FROM k UNION ALL SELECT 'float', text, value, prior::DOUBLE FROM f UNION ALL SELECT 'platelets', text, value, 0.0::DOUBLE FROM h
UNION ALL SELECT 'age', n || u, n::VARCHAR, 0.0::DOUBLE FROM range(12, 56) a(n), (VALUES (''), ('ans'), ('jours'), ('j')) b(u)""")
def candidate_numbers(spark, sf_dir):
    kinds = [("kg", "weight_kg", "kg", 30, 160), ("float", "glycemia_g_l", "float", 0.4, 4), ("platelets", "platelets", "str", None, None), ("age", "age", "int", 12, 55)]
    parts = [decode.candidates(spark, column, dtype, lo, hi).withColumn("kind", F.lit(kind)) for kind, column, dtype, lo, hi in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).select("kind", "text", "value", "prior")


_HELD = {"RAS": 4, "Pâle": 2}


@query("candidate_words", f"""WITH v AS (SELECT DISTINCT w FROM (VALUES {_values((w,) for w in dict.fromkeys([*decode.VOCABULARIES['clinical'], *decode.EXTRA_WORDS, *_HELD]))}) v(w)), t AS (SELECT 6 + count(*) AS t FROM v), c(w, n) AS (VALUES ('RAS', 4), ('Pâle', 2))
SELECT v.w AS text, v.w AS value, round(ln((coalesce(n, 0) + 1) / t), 6) AS prior FROM v LEFT JOIN c USING (w), t""")
def candidate_words(spark, sf_dir):
    return decode.candidates(spark, "conjunctivae", "str", counts=_HELD).withColumn("prior", F.round("prior", 6))


@query("plausible_readings", f"""WITH g AS (SELECT DISTINCT s || '/' || d AS t FROM range(7, 23) a(s), range(4, 14) b(d) WHERE d < s UNION SELECT s * 10 || '/' || d * 10 FROM range(7, 23) a(s), range(4, 14) b(d) WHERE d < s UNION SELECT s || '/' || d FROM range(80, 200) a(s), range(40, 130) b(d) WHERE d + 10 <= s AND (s % 10 <> 0 OR d % 10 <> 0))
SELECT id, replace({FOLD}, ' ', '') IN (SELECT t FROM g) AS plausible FROM {READING_VALUES}""".replace("IN (SELECT t FROM g) AS", "IN (SELECT t FROM g) AND x IS NOT NULL AS"))
def plausible_readings(spark, sf_dir):
    rows = decode.plausible(_readings(spark).withColumnRenamed("x", "text"), decode.candidates(spark, "blood_pressure", "bp"))
    return rows.select("id", F.when(F.col("text").isNotNull(), F.col("plausible")).otherwise(F.col("text").isNotNull()).alias("plausible"))


@query("posterior_topk", """WITH t AS (SELECT l_orderkey AS crop, l_linenumber || '-' || l_partkey AS text, -l_quantity / 10 - 0.5 * l_tax AS total FROM lineitem),
e AS (SELECT *, exp(total - max(total) OVER (PARTITION BY crop)) AS e FROM t)
SELECT crop, text, rank, posterior FROM (SELECT crop, text, row_number() OVER (PARTITION BY crop ORDER BY total DESC, text)::INT AS rank, round(e / sum(e) OVER (PARTITION BY crop), 6) AS posterior FROM e) WHERE rank <= 3""")
def posterior_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("crop"), F.concat_ws("-", "l_linenumber", "l_partkey").alias("text"), (-F.col("l_quantity") / 10).alias("score"), (-F.col("l_tax")).alias("prior"))
    return decode.posterior(rows).withColumn("posterior", F.round("posterior", 6))


@query("ctc_score")
def ctc_score(spark, sf_dir):
    crops = spark.createDataFrame([(1, [[0.1, 0.8, 0.1], [0.6, 0.2, 0.2], [0.1, 0.1, 0.8]]), (2, [[0.5, 0.25, 0.25]] * 4)], "crop bigint, probs array<array<double>>")
    wanted = spark.createDataFrame([(c, t) for c in (1, 2) for t in ("a", "b", "ab", "aa", "ba", "")], "crop bigint, text string")
    return decode.ctc_score(crops, wanted, ["", "a", "b"]).select("crop", "text", F.round("score", 9).alias("score"), F.round("free", 9).alias("free"))


@query("span_words")
def span_words(spark, sf_dir):
    """The word across a section, from its crop's probabilities: no priors, a few words, both recognisers."""
    charset = ["", *"RASNéantorml .ugifcéen"]
    crops = spark.createDataFrame([(1, [[0.02] + [0.9 if c == ch else 0.003 for c in charset[1:]] for ch in "RAS"] * 1)], "crop bigint, probs array<array<double>>")
    words = spark.createDataFrame([(1, w) for w in decode.SPAN_WORDS], "crop bigint, text string")
    scored = decode.ctc_score(crops, words, charset)
    best = decode.posterior(decode.with_small(scored, scored).withColumn("prior", F.lit(0.0)))
    return best.select("crop", "text", "rank", F.round("posterior", 6).alias("posterior"), F.round(decode.confidence(F.col("posterior"), F.col("fit")), 6).alias("confidence"))


@query("pii_ui_shape", "SELECT c_custkey AS page, 'segment' AS key, 'segment' AS label, coalesce(nullif(c_mktsegment, 'BUILDING'), '—') AS value, round(abs(c_acctbal) / 10000, 2) AS conf, 'KNOWN' AS status FROM customer")
def pii_ui_shape(spark, sf_dir):
    people = table(spark, sf_dir, "customer")
    field = lambda key, value, pii: F.struct(F.lit(key).alias("key"), value.alias("display"), F.lit(pii).alias("pii"))
    rows = people.select(F.col("c_custkey").alias("page"), (F.abs("c_acctbal") / 10000).alias("confidence"), F.explode(F.array(field("name", F.col("c_name"), True), field("segment", F.nullif("c_mktsegment", F.lit("BUILDING")), False))).alias("f"))
    fields = rows.select("page", "confidence", "f.*", F.lit(None).cast("string").alias("label"), F.lit("KNOWN").alias("status"))
    return records.ui_shape(records.without_pii(fields))


# ---- readings, answers and times

_reading_query("separator_only", {"only": X.separators_only}, f"""WITH t AS (SELECT id, regexp_replace(coalesce(x, ''), '\\s', '', 'g') AS t FROM {READING_VALUES})
SELECT id, t = '' OR (length(t) <= 4 AND regexp_matches(t, '^[/|1lI_\\-.()\\[\\]]*$') AND (regexp_matches(t, '[/|_]') OR length(t) >= 2)) AS only FROM t""")
_reading_query("reading_cleanup", {"text": X.without_separators}, f"SELECT id, trim(regexp_replace(regexp_replace(coalesce(x, ''), '^[\\s/_|.:;,\\-–]+|[\\s/_|.:;,]+$', '', 'g'), '\\s+', ' ', 'g')) AS text FROM {READING_VALUES}")
_reading_query("prior_numbers", {"systolic": lambda x: X.pressure_in_cm(x)["systolic"], "diastolic": lambda x: X.pressure_in_cm(x)["diastolic"], "n": X.number}, f"""
WITH g AS (SELECT id, x, try_cast(regexp_extract(x, '^\\s*(\\d+)\\s*/\\s*(\\d+)', 1) AS DOUBLE) AS s, try_cast(regexp_extract(x, '^\\s*(\\d+)\\s*/\\s*(\\d+)', 2) AS DOUBLE) AS d FROM {READING_VALUES})
SELECT id, CASE WHEN s > 30 THEN s / 10 ELSE s END AS systolic, CASE WHEN s > 30 THEN d / 10 ELSE d END AS diastolic, {NUM('x')} AS n FROM g""")

GAPPED = [("Bouchra", "bouchra"), ("F�s", "Fès"), ("F�s", "fs"), ("F�s", "frais"), ("�", "—"), ("a+b (c)", "A+B (c)"), ("a+b", "aab"), ("12/03", "12-03"), (None, "x"), ("x", None), ("", "")]


@query("gap_matches", f"""WITH v AS (SELECT * FROM (VALUES {_values((i, *r) for i, r in enumerate(GAPPED))}) v(id, truth, got)),
s AS (SELECT id, regexp_replace({FOLD.replace('lower(x)', 'lower(truth)')}, '[\\s.,;:''’\\-_/]', '', 'g') AS t, regexp_replace({FOLD.replace('lower(x)', 'lower(got)')}, '[\\s.,;:''’\\-_/]', '', 'g') AS g FROM v)
SELECT id, regexp_matches(g, '^' || replace(regexp_replace(t, '([.\\\\+*?()\\[\\]{{}}^$|])', '\\\\\\1', 'g'), '�', '.?') || '$') AS hit FROM s""")
def gap_matches(spark, sf_dir):
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(GAPPED)], "id bigint, truth string, got string")
    return rows.select("id", X.gap_matches(F.col("truth"), F.col("got")).alias("hit"))


TIMES = ["2024-05-01T10:00:00Z", "2024-05-01T10:00:00+02:00", "2024-05-01T10:00:00", "2024-05-01", "2035-01-01T00:00:00Z", "no time", "", None]
NOW = "2025-01-01T00:00:00Z"


@query("capture_times", f"""WITH v AS (SELECT id, CASE WHEN regexp_matches(x, '^\\d{{4}}-\\d\\d-\\d\\d$') THEN x || 'T00:00:00' ELSE x END AS x FROM (VALUES {_values(enumerate(TIMES))}) v(id, x)),
t AS (SELECT id, try_cast(CASE WHEN regexp_matches(x, '(Z|[+\\-]\\d\\d:?\\d\\d)$') THEN x ELSE x || 'Z' END AS TIMESTAMPTZ) AS taken FROM v)
SELECT id, CASE WHEN taken IS NOT NULL THEN epoch(least(taken, TIMESTAMPTZ '{NOW}'))::BIGINT END AS second FROM t""")
def capture_times(spark, sf_dir):
    from casebook.sources.readers import captured_at

    rows = spark.createDataFrame(list(enumerate(TIMES)), "id bigint, x string")
    return rows.select("id", F.unix_timestamp(captured_at(F.col("x"), F.to_timestamp(F.lit(NOW)))).alias("second"))


# ---- views, keys and rules over whole tables

_SHOWN = "SELECT c_custkey AS page, CASE c_custkey % 7 WHEN 0 THEN '' WHEN 1 THEN '☐' WHEN 2 THEN NULL ELSE c_mktsegment END AS display, CASE WHEN c_custkey % 5 = 0 THEN 'NOT_PROVIDED' WHEN c_custkey % 5 = 1 THEN 'NEEDS_REVIEW' WHEN c_custkey % 5 = 2 THEN 'ILLEGIBLE' ELSE 'KNOWN' END AS status FROM customer"


def _shown(spark, sf_dir) -> DataFrame:
    key, rest = F.col("c_custkey") % 7, F.col("c_custkey") % 5
    display = F.when(key == 0, "").when(key == 1, "☐").when(key == 2, None).otherwise(F.col("c_mktsegment"))
    status = F.when(rest == 0, "NOT_PROVIDED").when(rest == 1, "NEEDS_REVIEW").when(rest == 2, "ILLEGIBLE").otherwise("KNOWN")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page"), display.alias("display"), status.alias("status"))


@query("filled_fields", f"SELECT page, display, status FROM ({_SHOWN}) WHERE coalesce(display, '') NOT IN ('', '☐') AND status <> 'NOT_PROVIDED'")
def filled_fields(spark, sf_dir):
    return records.filled(_shown(spark, sf_dir))


@query("record_number", f"SELECT page, CASE WHEN status IN ('KNOWN', 'NEEDS_REVIEW') THEN display END AS record_number FROM ({_SHOWN})")
def record_number(spark, sf_dir):
    return records.record_number(_shown(spark, sf_dir).withColumnRenamed("display", "value").withColumn("key", F.lit("record_number")))


@query("linking_always_review", f"SELECT page, 'code' AS key, 'patient code: confirm before linking the visit' AS issue, 0.79::DOUBLE AS cap, 1 AS ord FROM ({_SHOWN})")
def linking_always_review(spark, sf_dir):
    return rules.linking(_shown(spark, sf_dir).select("page", F.explode(F.array(F.struct(F.lit("code").alias("key"), F.lit(True).alias("linking")), F.struct(F.lit("name").alias("key"), F.lit(False).alias("linking")))).alias("f")).select("page", "f.*"))


@query("rule_facility", f"""WITH p AS (SELECT page, CASE page % 3 WHEN 0 THEN 'DR' WHEN 1 THEN 'CSC' END AS prefix, CASE page % 2 WHEN 0 THEN 'DR' ELSE 'CSU' END AS type, status FROM ({_SHOWN}))
SELECT page, key FROM p, (VALUES ('facility_name'), ('facility_type')) k(key) WHERE status = 'KNOWN' AND prefix <> type""")
def rule_facility(spark, sf_dir):
    prefix = F.when(F.col("page") % 3 == 0, "DR").when(F.col("page") % 3 == 1, "CSC")
    pages = _shown(spark, sf_dir).select("page", prefix.alias("name_prefix"), F.when(F.col("page") % 2 == 0, "DR").otherwise("CSU").alias("type"), F.col("status").alias("type_status"))
    return rules.facility_type(pages).select("page", "key")


@query("repeated_keys", "SELECT p_brand, p_type, count(*)::BIGINT AS n FROM part GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_keys(spark, sf_dir):
    return records.repeated_keys(table(spark, sf_dir, "part"), "p_brand", "p_type")


@query("new_patients", "SELECT DISTINCT user_id AS code FROM events WHERE user_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id AND c_custkey % 2 = 0)")
def new_patients(spark, sf_dir):
    seen = table(spark, sf_dir, "events").select(F.col("user_id").alias("code")).where("code IS NOT NULL").distinct()
    return records.new_rows(table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("code")), seen, "code")


@query("encrypted_round_trip", "SELECT c_custkey AS page, sha256(c_name) AS sha256, true AS hidden FROM customer")
def encrypted_round_trip(spark, sf_dir):
    from casebook.sources.sinks import decrypted, encrypted

    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page"), F.col("c_name").alias("name"), F.unhex(F.md5(F.col("c_custkey").cast("string"))).alias("key"))
    stored = encrypted(rows.withColumn("own_key", F.col("key")), "name", "key").withColumn("cipher", F.col("name"))
    return decrypted(stored, "name", "own_key").select("page", F.sha2(F.col("name").cast("binary"), 256).alias("sha256"), (F.col("cipher") != F.col("name").cast("binary")).alias("hidden"))


# ---- layouts

@query("marked_boxes", """SELECT p_partkey AS box FROM part WHERE EXISTS (SELECT 1 FROM supplier WHERE s_suppkey % 10 = p_partkey % 10
  AND abs(s_acctbal) / 10 <= p_retailprice + 6 AND abs(s_acctbal) / 10 + 2 >= p_retailprice - 1 AND s_suppkey % 50 <= p_size + 2 AND s_suppkey % 50 + 1 >= p_size - 1)""")
def marked_boxes(spark, sf_dir):
    boxes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("box"), (F.col("p_partkey") % 10).alias("page"), F.col("p_retailprice").alias("x0"), (F.col("p_retailprice") + 5).alias("x1"), F.col("p_size").alias("y0"), (F.col("p_size") + 1).alias("y1"))
    x, y = F.abs("s_acctbal") / 10, F.col("s_suppkey") % 50
    marks = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 10).alias("page"), x.alias("mx0"), (x + 2).alias("mx1"), y.alias("my0"), (y + 1).alias("my1"))
    return geometry.marked_boxes(boxes, marks).select("box")


@query("nearest_repeat", """WITH d AS (SELECT s_suppkey AS place, c_custkey AS spot, c_acctbal - (s_acctbal * 1.01::DOUBLE + s_suppkey * 0::DOUBLE + 2) AS du, c_custkey % 100 - (s_acctbal * 0::DOUBLE + s_suppkey * 1::DOUBLE + 1) AS dv
  FROM supplier JOIN customer ON c_nationkey = s_nationkey AND c_custkey % 50 = s_suppkey % 50)
SELECT place, spot FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY du * du + dv * dv, spot) AS n FROM d) WHERE n = 1""")
def nearest_repeat(spark, sf_dir):
    template = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("page"), (F.col("s_suppkey") % 50).alias("label"), F.col("s_suppkey").alias("place"), F.col("s_acctbal").alias("x"), F.col("s_suppkey").alias("y"))
    found = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("page"), (F.col("c_custkey") % 50).alias("label"), F.col("c_custkey").alias("spot"), F.col("c_acctbal").alias("px"), (F.col("c_custkey") % 100).alias("py"))
    return geometry.nearest_repeat(template, found, (1.01, 0.0, 2.0, 0.0, 1.0, 1.0))


@query("row_reach", """WITH g AS (SELECT l_orderkey AS t, l_quantity - lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS gap FROM lineitem)
SELECT t AS "table", round(coalesce(min(gap) FILTER (WHERE gap > 5) * 0.48::DOUBLE, 9), 6) AS reach FROM g GROUP BY t""")
def row_reach(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("table"), F.col("l_quantity").alias("y"))
    return geometry.row_reach(rows).select("table", F.round("reach", 6).alias("reach"))


@query("voted_pixels", "SELECT l_suppkey AS x, l_linenumber AS y, count(*)::BIGINT AS votes FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 3")
def voted_pixels(spark, sf_dir):
    return geometry.voted_pixels(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("x"), F.col("l_linenumber").alias("y")))


ANCHORS = [("BUILDING", 1), ("AUTO", 0), ("HOUSEHOLD", 100000), ("M", 2), ("none", 0)]


@query("nth_label", f"""WITH m AS (SELECT c_nationkey AS page, anchor, nth, c_custkey AS id, c_mktsegment = anchor AS same FROM customer JOIN (VALUES {_values(ANCHORS)}) a(anchor, nth) ON starts_with(c_mktsegment, anchor)),
b AS (SELECT * FROM (SELECT *, bool_or(same) OVER (PARTITION BY page, anchor) AS has FROM m) WHERE same = has)
SELECT page, anchor, id FROM (SELECT *, row_number() OVER (PARTITION BY page, anchor ORDER BY id) - 1 AS n FROM b) WHERE n = nth""")
def nth_label(spark, sf_dir):
    labels = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("page"), F.col("c_mktsegment").alias("label"), F.col("c_custkey").alias("id"))
    return geometry.nth_label(labels, spark.createDataFrame(ANCHORS, "anchor string, nth int"))


@query("glyphs_to_text", """WITH g AS (SELECT user_id AS line, event_id, substr(event_type, 1, 1) AS ch, value - lag(value + 1) OVER (PARTITION BY user_id ORDER BY event_id) > 10 * 0.45::DOUBLE AS wide FROM events)
SELECT line, trim(regexp_replace(string_agg(CASE WHEN wide THEN ' ' || ch ELSE ch END, '' ORDER BY event_id), '\\s+', ' ', 'g')) AS text FROM g GROUP BY line""")
def glyphs_to_text(spark, sf_dir):
    glyphs = table(spark, sf_dir, "events").select(F.col("user_id").alias("line"), F.col("event_id").alias("ord"), F.substring("event_type", 1, 1).alias("ch"), F.col("value").alias("x0"), (F.col("value") + 1).alias("x1"), F.lit(10).alias("height"))
    return geometry.glyphs_to_text(glyphs)


ROW_SHARES = [("first", 0, 0.25), ("middle", 1, 0.5), ("last", 3, 0.9)]


@query("rows_between_bands", f"""WITH b AS (SELECT l_orderkey AS page, l_quantity AS y, row_number() OVER w - 1 AS band, lead(l_quantity) OVER w AS nxt, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_quantity))
SELECT page, r AS "row", round(y + coalesce(share::DOUBLE * (nxt - y), 0), 6) AS y FROM b JOIN (VALUES {_values(ROW_SHARES)}) a(r, band, share) USING (band) WHERE n = 4""")
def rows_between_bands(spark, sf_dir):
    bands = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_quantity").alias("y"))
    return geometry.rows_between_bands(bands, spark.createDataFrame(ROW_SHARES, "row string, band int, share double")).select("page", "row", F.round("y", 6).alias("y"))


@query("box_overlap", """SELECT p_partkey AS box, round(w * h / (p_size * 10 + 100 - w * h), 6) AS iou FROM (SELECT *, greatest(0, least(p_size, p_size / 2 + 10) - p_size / 2)::DOUBLE AS w, greatest(0, least(10, 15) - 5)::DOUBLE AS h FROM part)""")
def box_overlap(spark, sf_dir):
    half = F.col("p_size") / 2
    sides = {"a_x0": F.lit(0.0), "a_y0": F.lit(0.0), "a_x1": F.col("p_size").cast("double"), "a_y1": F.lit(10.0), "b_x0": half, "b_y0": F.lit(5.0), "b_x1": half + 10, "b_y1": F.lit(15.0)}
    return table(spark, sf_dir, "part").withColumns(sides).select(F.col("p_partkey").alias("box"), F.round(geometry.iou("a", "b"), 6).alias("iou"))


@query("photo_issues", "SELECT p_partkey AS photo, concat_ws(',', CASE WHEN p_size * 3 < 60 THEN 'blurry' END, CASE WHEN p_size / 50 < 0.25 THEN 'too dark' END, CASE WHEN p_size / 50 > 0.97 THEN 'too bright' END, CASE WHEN p_partkey % 1000 < 800 THEN 'too small' END) AS issues FROM part")
def photo_issues(spark, sf_dir):
    issues = geometry.image_quality(F.col("p_size") * 3, F.col("p_size") / 50, F.col("p_partkey") % 1000)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("photo"), F.array_join(issues, ",").alias("issues"))


SIGNATURES = [("cover", 1, x) for x in (1, 2, 3)] + [("delivery", 2, x) for x in (3, 4, 5, 6)] + [("visit", 3, x) for x in (2, 7)]


@query("signature_layout", f"""WITH s(layout, ord, label) AS (VALUES {_values(SIGNATURES)}), z AS (SELECT layout, count(*) AS size FROM s GROUP BY 1),
h AS (SELECT l_orderkey AS page, layout, ord, count(DISTINCT label) / any_value(size) AS score FROM lineitem JOIN s ON l_linenumber = label JOIN z USING (layout) GROUP BY 1, 2, 3),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, ord) AS n FROM h) WHERE n = 1)
SELECT page, CASE WHEN score >= 0.6 THEN layout END AS layout, round(coalesce(score, 0), 4) AS score FROM (SELECT DISTINCT l_orderkey AS page FROM lineitem) LEFT JOIN b USING (page)""")
def signature_layout(spark, sf_dir):
    seen = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("label"))
    return match.signature_layout(seen, spark.createDataFrame(SIGNATURES, "layout string, ord int, label int"))


# ---- truths and totals

@query("choice_truth", """SELECT l_orderkey AS page, CASE count(*) FILTER (WHERE l_tax >= 0.07) WHEN 0 THEN 'NOT_PROVIDED' WHEN 1 THEN 'KNOWN' ELSE 'NEEDS_REVIEW' END AS status,
 coalesce(string_agg(l_linenumber, ',' ORDER BY l_linenumber) FILTER (WHERE l_tax >= 0.07), '') AS value FROM lineitem GROUP BY 1""")
def choice_truth(spark, sf_dir):
    options = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("option"), (F.col("l_tax") >= 0.07).alias("ticked"))
    return evaluate.choice_truth(options, "page")


@query("photo_totals", f"SELECT l_orderkey % 50 AS photo, count(*)::BIGINT AS fields, count_if(value_ok)::BIGINT AS correct, count_if(pred_status = 'KNOWN' AND NOT value_ok)::BIGINT AS silent, count_if(pred_status IN ('NEEDS_REVIEW', 'ILLEGIBLE'))::BIGINT AS review FROM ({_EVAL}) GROUP BY 1")
def photo_totals(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey % 50 AS photo", _PRED, "l_quantity > 5 AS value_ok")
    return evaluate.photo_totals(rows)


@query("page_accuracy", "SELECT count(*)::BIGINT AS pages, round(avg((o_orderstatus = 'F')::INT), 4) AS accuracy, round(avg(o_totalprice), 2) AS seconds FROM orders")
def page_accuracy(spark, sf_dir):
    return evaluate.page_accuracy(table(spark, sf_dir, "orders").select(F.lit("F").alias("expected"), F.col("o_orderstatus").alias("got"), F.col("o_totalprice").alias("seconds")))


from casebook import form_queries  # noqa: E402, F401  (registers its queries)
