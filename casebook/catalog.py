"""The form's catalog as dimensions: its fields, their options, and the questions that a reviewer is asked.

Pages are written as short lines (key, type, marks); tables as rows by columns. Labels are a parameter: a catalog knows keys
and types, a deployment its languages. Without labels a field's key is its label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Fields of each page, in order. ``key:dtype``, then ``[lo,hi]`` for a plausible range, ``!`` for a field
#: that links records, ``*`` for an identifier of a person, which is never extracted; ``key?`` is a box, ``key=a|b`` a choice.
COVER = "record_number:code! region:str province:str facility_name:str facility_type=DR|CSC|CSU|CSCA|CSUA coverage_mode=fixed|mobile patient_name:str* high_risk? risk.anemia? risk.hypertension? risk.diabetes? risk.cardiopathy? risk.metrorrhagia? risk.infection? risk.preeclampsia? risk.eclampsia? risk.other:str"
IDENTIFICATION = "age:int[12,55] national_id:str* education_level:str profession:str address:str* phone:str* husband_name:str* husband_profession:str consanguinity? desired_pregnancy? @family_history @woman_history @obstetric_anomalies @previous_delivery gravidity:int[1,20] parity:int[0,20] living_children:int[0,20] tetanus_dose_1? tetanus_dose_2? tetanus_dose_3? tetanus_dose_4? tetanus_dose_5? rubella_vaccinated? rubella_vaccination_date:date hepatitis_b_vaccinated? hepatitis_b_vaccination_date:date cervical_screening:str"
CURRENT_PREGNANCY = "lmp_date:date height_cm:cm[120,200] blood_group=A|B|O|AB rhesus=negative|positive expected_delivery_date:date term_exceeded_date:date @visits"
DELIVERY = "patient_name:str* setting=supervised|home facility=birth_house|maternity|private_clinic facility_other:str home_skilled_attendant? home_other:str delivery_date:date mode=vaginal_spontaneous|vaginal_instrumental|cesarean_planned|cesarean_emergency forceps? vacuum? episiotomy? cesarean_indication:str complications? complication_at_delivery? complication_postpartum? complication.preeclampsia? complication.eclampsia? complication.hemorrhage? complication.infection? complication.other? complication_other_text:str newborn_status=alive|stillborn|death_under_24h newborn_sex:sex birth_weight_g:grams[300,6500] head_circumference_cm:cm[20,45] anomaly:str gestational_age_weeks:weeks[20,45]"
MOTHER = "consultation_date:date timing={timing} temperature_c:temp[34,42] blood_pressure:bp pulse_bpm:int[40,160] weight_kg:kg[30,160] conjunctivae=normal|pale uterine_globe? lochia.bland? lochia.foul? lochia.clear? lochia.bloody? lochia.yellowish? perineum=normal|episiotomy|tear episiotomy_repaired? sphincters=normal|abnormal cesarean? scar_state:str breasts=normal|lymphangitis|mastitis_abscess calves.normal? calves.red? calves.warm? calves.painful? complications? complication.hemorrhage? complication.infection? complication.eclampsia? complication.phlebitis? complication.breast? complication.anemia? complication.other? taking_medication? medication_details:str treatment.iron? treatment.vitamin_a? treatment.other:str next_appointment_date:date family_planning.wants_method? family_planning.method=pill|iud family_planning.method_other:str family_planning.prescribed? family_planning.referred? family_planning.reason_declined:str"
NEWBORN = "consultation_date:date age:days[0,120] temperature_c:temp[34,42] weight_g:grams[500,9000] length_cm:cm[30,75] head_circumference_cm:cm[25,45] premature? hypotrophic? feeding=exclusive_breastfeeding|formula|mixed danger.convulsions? danger.refuses_feeding? danger.hematemesis? danger.melena? danger.diarrhea? danger.jaundice? danger.chest_indrawing? danger.cough? danger.abnormal_breathing? danger.fever? danger.hypothermia? danger.other:str trauma.cephalhematoma? trauma.hip_dislocation? trauma.limb_mobility? trauma.other:str breastfeeding_assessment=normal|problems vaccine.bcg? vaccine.hepatitis_b? vitamin_d? complication.jaundice? complication.infection? complication.conjunctivitis? complication.trauma? complication.malformation? complication.other? seen_by:str decision:str treatment:str transfer? referral_facility:str next_visit_date:date"
#: Tables as rows and columns; a column with a type overrides its rows'.
TABLES = {
    "family_history": ("hypertension:str diabetes:str hereditary:str malformations:str allergies:str", "woman_family husband_family"),
    "woman_history": ("hypertension:str", "medical surgical gynecological"),
    "obstetric_anomalies": ("abortion:str premature_delivery:str fetal_death:str other:str", "count:int[0,20] date:date_or_year place:str gestational_age:weeks[4,44]"),
    "previous_delivery": ("date:date mode:str cesarean_indication:str complication:str newborn_weight_g:grams[300,6500] newborn_complication:str", "1 2 3 4 5"),
    "visits": (
        "appointment_date:date attended_date:date reminder_visit:yesno gestational_age_weeks:weeks[4,44] weight_kg:kg[30,160] blood_pressure:bp skeletal_anomalies:str conjunctivae:str breast_exam:str edema:yesno fetal_movements:yesno fundal_height_cm:int[5,45] fetal_heart_rate:int[90,200] speculum_exam:str cervix:str presentation:str pelvis:str glycosuria:posneg albuminuria:posneg rubella:str toxoplasmosis:str syphilis:posneg hepatitis_b:posneg hiv:posneg hemoglobin_g_dl:float[5,16] platelets:str glycemia_g_l:float[0.4,4] rai:posneg iron:yesno examined_by:str",
        "t1_v1 t1_v2 t1_v3 t2_v1 t2_v2 t2_v3 m7 m8 m9",
    ),
}
EARLY, LATE = "day_7_8|after_day_8", "day_40_50|after_day_50"
PAGES = {
    "cover": COVER, "identification": IDENTIFICATION, "current_pregnancy": CURRENT_PREGNANCY, "delivery": DELIVERY,
    "postpartum_early_mother": MOTHER.replace("{timing}", EARLY), "postpartum_early_newborn": NEWBORN,
    "postpartum_late_mother": MOTHER.replace("{timing}", LATE), "postpartum_late_newborn": NEWBORN,
}
FIELD = "page_type string, ord int, key string, kind string, dtype string, lo double, hi double, pii boolean, linking boolean, options array<string>"


def _typed(word: str) -> tuple[str, str | None, float | None, float | None, str]:
    """(key, dtype, lo, hi, marks) of ``key:dtype[lo,hi]marks``; no dtype where none is given."""
    key, _, rest = word.partition(":")
    marks = rest[len(rest.rstrip("!*")) :]
    dtype, _, bounds = rest.rstrip("!*").partition("[")
    lo, hi = (float(x) for x in bounds.rstrip("]").split(",")) if bounds else (None, None)
    return key, dtype or None, lo, hi, marks


def page_fields(page: str) -> list[tuple]:
    """(key, kind, dtype, lo, hi, pii, linking, options) of a page's fields, in order."""
    out = []
    for word in page.split():
        if word[0] == "@":
            rows, cols = (list(map(_typed, side.split())) for side in TABLES[word[1:]])
            for col, own, lo, hi, _ in cols:
                out += [(f"{word[1:]}.{col}.{row}", "cell", own or dtype, lo if own else low, hi if own else high, False, False, None) for row, dtype, low, high, _ in rows]
        elif word[-1] == "?":
            out.append((word[:-1], "check", "bool", None, None, False, False, None))
        elif "=" in word:
            key, _, options = word.partition("=")
            out.append((key, "radio", "enum", None, None, False, False, options.split("|")))
        else:
            key, dtype, lo, hi, marks = _typed(word)
            out.append((key, "text", dtype, lo, hi, "*" in marks, "!" in marks, None))
    return out


def fields(spark, pages: dict[str, str] = PAGES, pii: bool = False) -> DataFrame:
    """The dimension of fields (FIELD); identifiers of persons only where asked for."""
    rows = [(page, n, *f) for page, text in pages.items() for n, f in enumerate(page_fields(text)) if pii or not f[5]]
    return spark.createDataFrame(rows, FIELD)


def options(fields: DataFrame) -> DataFrame:
    """(page_type, key, ord, option) of all choices."""
    return fields.where("kind = 'radio'").select("page_type", "key", F.posexplode("options").alias("ord", "option"))


def labelled(fields: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Fields with label_fr, label_en, question_fr and question_en. ``labels``: (page_type, key, label_fr, label_en)."""
    rows = fields.join(labels, ["page_type", "key"], "left") if labels is not None else fields.withColumns({"label_fr": F.lit(None).cast("string"), "label_en": F.lit(None).cast("string")})
    rows = rows.withColumns({c: F.coalesce(c, "key") for c in ("label_fr", "label_en")})
    return rows.withColumns({"question_fr": question("fr", F.col("kind"), F.col("label_fr")), "question_en": question("en", F.col("kind"), F.col("label_en"))})


#: Questions by language and kind of field.
QUESTIONS = {
    "fr": {"check": "La case « %s » est-elle cochée ?", "radio": "Quelle option est cochée pour « %s » ?", "": "Quelle est la valeur de « %s » ?"},
    "en": {"check": "Is the box “%s” ticked?", "radio": "Which option is ticked for “%s”?", "": "What is the value of “%s”?"},
}


def question(language: str, kind: Column, label: Column) -> Column:
    """What a reviewer is asked about a field."""
    texts = QUESTIONS[language]
    return F.when(kind == "check", F.format_string(texts["check"], label)).when(kind == "radio", F.format_string(texts["radio"], label)).otherwise(F.format_string(texts[""], label))


def empty_form(fields: DataFrame, page_type: str) -> DataFrame:
    """The fields of a page to be filled by hand: all NOT_PROVIDED with no confidence. ValueError for no such page."""
    if not fields.where(F.col("page_type") == page_type).limit(1).count():
        raise ValueError(f"{page_type} is no page of the catalog")
    none = F.lit(None).cast("string")
    return fields.where(F.col("page_type") == page_type).select("page_type", "ord", "key", "kind", "dtype", none.alias("value"), none.alias("display"), none.alias("raw"), F.lit("NOT_PROVIDED").alias("status"), F.lit(0.0).alias("confidence"), F.array().cast("array<string>").alias("issues"))


def field(fields: DataFrame, page_type: str, key: str):
    """One field's row; KeyError where the catalog has none."""
    found = fields.where((F.col("page_type") == page_type) & (F.col("key") == key)).limit(1).collect()
    if not found:
        raise KeyError(f"{page_type}.{key}")
    return found[0]


#: Tables whose cells share a prior by the last part of their key.
PRIOR_TABLES = ["visits.", "previous_delivery.", "obstetric_anomalies.", "family_history.", "woman_history."]


def prior_column(key: Column) -> Column:
    """The column whose prior a field uses: the last part of a table cell's key, else the key."""
    in_table = F.lit(False)
    for prefix in PRIOR_TABLES:
        in_table = in_table | key.startswith(prefix)
    return F.when(in_table, F.substring_index(key, ".", -1)).otherwise(key)
