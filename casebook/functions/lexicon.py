"""Vocabularies of free-text fields, which field uses which, and the nearest word of a vocabulary."""

from __future__ import annotations

import difflib
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F

from casebook.functions.unfold import fold_text

#: The words of each vocabulary.
VOCABULARIES = {
    "clinical": [
        "RAS", "Néant", "Aucun", "Aucune", "Normal", "Normale", "Normales", "Normaux", "Anormal", "Anormale", "Pâles", "Décolorées", "Fermé", "Ouvert", "Effacé", "Céphalique", "Siège", "Transverse",
        "Immune", "Non immune", "Oui", "Non", "Neg", "Pos", "Positif", "Négatif", "Propre", "Propre, sèche", "Infectée", "Suintante", "Voie basse", "Césarienne", "Forceps", "Ventouse", "Maternité",
        "Domicile", "Hôpital", "Clinique", "Mère", "Père", "Oncle", "Tante", "Frère", "Sœur", "Grand-mère", "Grand-père", "Cycles réguliers", "Cycles irréguliers", "Non fait", "Fait",
        "Souffrance fœtale", "SFA", "Utérus cicatriciel", "Pré-éclampsie", "Pré-éclampsie sévère", "Éclampsie", "Hémorragie", "Infection", "Anémie", "HTA", "Diabète", "Asthme", "Asthme léger",
        "Épilepsie", "Cardiopathie", "Appendicectomie", "Cholécystectomie", "Fer", "Acide folique", "Vitamine A", "Vitamine D", "Sage-femme", "Infirmière", "Médecin",
        "Poursuivre l'allaitement exclusif", "Dystocie", "Macrosomie", "Prématurité", "Colorées", "Colorés", "Reçu", "Echo obst", "Test rapide", "Vit D", "À faire",
    ],
    "education": ["Aucun", "Analphabète", "Primaire", "Collège", "Lycée", "Supérieur", "Universitaire", "Secondaire", "Alphabétisée"],
    "occupation": [
        "Femme au foyer", "Sans profession", "Agricultrice", "Agriculteur", "Étudiante", "Étudiant", "Couturière", "Commerçante", "Commerçant", "Employée", "Employé", "Fonctionnaire", "Ouvrière",
        "Ouvrier", "Chauffeur", "Mécanicien", "Maçon", "Enseignante", "Enseignant", "Infirmière", "Coiffeuse", "Artisan", "Artisane", "Menuisier", "Électricien", "Plombier", "Pêcheur", "Berger",
        "Militaire", "Policier", "Gardien", "Journalier", "Vendeuse", "Vendeur", "Cultivateur", "Éleveur", "Retraité", "Chômeur", "Sans emploi",
    ],
    "region": [
        "Tanger-Tétouan-Al Hoceïma", "Oriental", "Fès-Meknès", "Rabat-Salé-Kénitra", "Béni Mellal-Khénifra", "Casablanca-Settat", "Marrakech-Safi", "Drâa-Tafilalet", "Souss-Massa",
        "Guelmim-Oued Noun", "Laâyoune-Sakia El Hamra", "Dakhla-Oued Ed-Dahab",
    ],
    "province": [
        "Tanger-Assilah", "M'diq-Fnideq", "Tétouan", "Fahs-Anjra", "Larache", "Al Hoceïma", "Chefchaouen", "Ouezzane", "Oujda-Angad", "Nador", "Driouch", "Jerada", "Berkane", "Taourirt", "Guercif",
        "Figuig", "Fès", "Meknès", "El Hajeb", "Ifrane", "Moulay Yacoub", "Sefrou", "Boulemane", "Taounate", "Taza", "Rabat", "Salé", "Skhirate-Témara", "Kénitra", "Khémisset", "Sidi Kacem",
        "Sidi Slimane", "Béni Mellal", "Azilal", "Fquih Ben Salah", "Khénifra", "Khouribga", "Casablanca", "Mohammédia", "El Jadida", "Nouaceur", "Médiouna", "Benslimane", "Berrechid", "Settat",
        "Sidi Bennour", "Marrakech", "Chichaoua", "Al Haouz", "El Kelâa des Sraghna", "Essaouira", "Rehamna", "Safi", "Youssoufia", "Errachidia", "Ouarzazate", "Midelt", "Tinghir", "Zagora",
        "Agadir Ida-Outanane", "Inezgane-Aït Melloul", "Chtouka-Aït Baha", "Taroudant", "Tiznit", "Tata", "Guelmim", "Assa-Zag", "Tan-Tan", "Sidi Ifni", "Laâyoune", "Boujdour", "Tarfaya",
        "Es-Semara", "Oued Ed-Dahab", "Aousserd",
    ],
    "facility": ["DR", "CSC", "CSU", "CSCA", "CSUA"],
    "sign": ["Neg", "Pos"],
    "yesno": ["Oui", "Non"],
}
#: Spellings that count as one canonical value.
ALIASES = {"Colorés": "Colorées", "Normale": "Normal", "Aucune": "Aucun", "Négatif": "Neg", "Positif": "Pos"}
#: Fields whose value must be a word of their vocabulary, and fields that have none.
CLOSED = ["region", "province", "education_level"]
NO_VOCABULARY = ["facility_name", "record_number"]
CUTOFF, TIE, DOUBT = 0.78, 0.05, 0.6


def vocabulary(key: Column) -> Column:
    """The name of a free-text field's vocabulary; null where it has none."""
    none = key.isin(NO_VOCABULARY) | key.endswith("examined_by") | key.endswith("seen_by") | F.contains(key, F.lit("platelets"))
    return (
        F.when(key.isin("region", "province"), key).when(key == "education_level", "education")
        .when(key.isin("profession", "husband_profession"), "occupation").when(~none, "clinical")
    )


@lru_cache(64)
def _forms(words: tuple[str, ...]) -> dict[str, str]:
    """Folded form to canonical value."""
    return {fold_text(w): ALIASES.get(w, w) for w in words}


def nearest(word: str, words: tuple[str, ...], cutoff: float = CUTOFF) -> tuple[str, float]:
    """The vocabulary's value for a word and how near it is: 1 for the word itself, less where another value is almost as
    near; a word with nothing near stays as it is. Of equally near forms the last by alphabet counts."""
    forms, key = _forms(words), fold_text(word)
    if key in forms or not forms:
        return forms.get(key, word), 1.0
    matcher = difflib.SequenceMatcher(None, "", "")
    matcher.set_seq1(key)
    first = second = (-1.0, "")
    for form in forms:
        matcher.set_seq2(form)
        if min(matcher.real_quick_ratio(), matcher.quick_ratio()) < second[0]:
            continue  # these are upper bounds of the ratio
        found = (matcher.ratio(), form)
        if found > first:
            first, second = found, first
        elif found > second:
            second = found
    if first[0] < cutoff:
        return word, 1.0
    rival = len(forms) > 1 and forms[second[1]] != forms[first[1]] and first[0] - second[0] < TIE
    return forms[first[1]], first[0] * (DOUBT if rival else 1.0)


def ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


def similar(text: Column, name: Column, cutoff: Column, vocabularies: dict[str, list[str]] = VOCABULARIES) -> Column:
    """struct(word, near, received, own) of a text in a named vocabulary: the nearest value and its ratio; of yes/no fields
    also the likeness to "recu", and to the one of "oui" and "non" that has the text's first letter. Null for null texts.
    A batch's distinct texts are compared once; vocabularies are parameters, a form's closed lists."""
    lists = {k: tuple(v) for k, v in vocabularies.items()}

    @F.pandas_udf("word string, near double, received double, own double")
    def run(text: pd.Series, name: pd.Series, cutoff: pd.Series) -> pd.DataFrame:
        def one(t, n, c):
            if t is None or n is None:
                return None, None, None, None
            word, near = nearest(t, lists[n], c)
            if n != "yesno":
                return word, near, None, None
            key = fold_text(t).strip(" .,")
            return word, near, ratio(key, "recu"), ratio(key, "oui" if key[:1] == "o" else "non")

        known: dict = {}
        rows = [known[k] if k in known else known.setdefault(k, one(*k)) for k in zip(text, name, cutoff)]
        return pd.DataFrame(rows, columns=["word", "near", "received", "own"])

    return run(text, name, cutoff)
