"""A seeded study of 200 records with engineered gaps, and the counts they must give."""
import random

from trialweave.operators.worklist import Workbook
from trialweave.plans.dictionary import Dictionary, Field

MISSING = "-666, Patient does not know | -777, Patient refused to answer | " \
          "-888, Missing in case notes | -999, Other missing"
DICTIONARY = Dictionary([
    Field("syn_id", "demographics", field_label="Study ID"),
    Field("sex", "demographics", field_type="radio", field_label="Sex",
          select_choices_or_calculations="1, Male | 2, Female"),
    Field("pregnancy_status", "demographics", field_type="radio", field_label="Pregnancy status",
          select_choices_or_calculations="1, Yes | 2, No | 3, Unknown", branching_logic="[sex] = '2'"),
    Field("symptoms", "clinical", field_type="checkbox", field_label="Symptoms",
          select_choices_or_calculations="1, Pain | 2, Weight loss | 3, Bleeding | 4, Fatigue"),
    Field("bleeding_severity", "clinical", field_type="radio", field_label="Bleeding severity",
          select_choices_or_calculations="1, Mild | 2, Moderate | 3, Severe",
          branching_logic="[symptoms(3)] = 1"),
    Field("histology_grade", "clinical", field_type="dropdown", field_label="Histology grade",
          select_choices_or_calculations="1, Well | 2, Moderate | 3, Poor | " + MISSING),
    Field("margin_status", "clinical", field_type="radio", field_label="Margin status",
          select_choices_or_calculations="1, Clear | 2, Close | 3, Involved"),
    Field("adjuvant_therapy", "clinical", field_type="radio", field_label="Adjuvant therapy",
          select_choices_or_calculations="1, Yes | 2, No | 3, Planned | " + MISSING,
          branching_logic="datediff([dx_date],[surgery_date],'d') > 30"),
    Field("follow_status", "follow_up", field_type="radio", field_label="Follow-up status",
          select_choices_or_calculations="1, Alive | 2, Recurred | 3, Died | 4, Lost"),
    Field("recurrence_site", "follow_up", field_type="radio", field_label="Recurrence site",
          select_choices_or_calculations="1, Local | 2, Liver | 3, Lung",
          branching_logic="[follow_status] = '2'"),
])
WORKBOOKS = Workbook.from_config({"workbooks": [
    {"name": "clinical_core", "title": "Clinical Core",
     "fields": ["bleeding_severity", "histology_grade", "margin_status", "adjuvant_therapy"]},
    {"name": "demo_followup", "fields": ["pregnancy_status", "recurrence_site"]}]})
# Applicable but blank, and holding a missing code, per site.
BLANK = {"site_alpha": {"pregnancy_status": 8, "bleeding_severity": 7, "histology_grade": 10,
                        "margin_status": 6, "recurrence_site": 5},
         "site_beta": {"pregnancy_status": 5, "bleeding_severity": 4, "histology_grade": 6,
                       "margin_status": 4, "recurrence_site": 3}}
CODES = {"site_alpha": {"histology_grade": 5, "adjuvant_therapy": 9},
         "site_beta": {"histology_grade": 3, "adjuvant_therapy": 6}}
# Gap and uncertain cells per workbook, site and mode.
EXPECTED = {
    ("clinical_core", "site_alpha", "with_MDC"): (28, 9),
    ("clinical_core", "site_alpha", "no_MDC"): (23, 0),
    ("clinical_core", "site_beta", "with_MDC"): (17, 6),
    ("clinical_core", "site_beta", "no_MDC"): (14, 0),
    ("demo_followup", "site_alpha", "with_MDC"): (13, 0),
    ("demo_followup", "site_alpha", "no_MDC"): (13, 0),
    ("demo_followup", "site_beta", "with_MDC"): (8, 0),
    ("demo_followup", "site_beta", "no_MDC"): (8, 0),
}
COLUMNS = ["syn_id", "redcap_data_access_group", "sex", "pregnancy_status", "symptoms___1",
           "symptoms___2", "symptoms___3", "symptoms___4", "bleeding_severity", "histology_grade",
           "margin_status", "adjuvant_therapy", "follow_status", "recurrence_site"]


def records(seed=20):
    rnd = random.Random(seed)
    out = []
    for site, size in (("site_alpha", 120), ("site_beta", 80)):
        rows = []
        for _ in range(size):
            r = {c: "" for c in COLUMNS}
            r["redcap_data_access_group"] = site
            r["sex"] = rnd.choice("12")
            r["pregnancy_status"] = rnd.choice("123") if r["sex"] == "2" else ""
            for i in range(1, 5):
                r[f"symptoms___{i}"] = rnd.choice("01")
            r["bleeding_severity"] = rnd.choice("123") if r["symptoms___3"] == "1" else ""
            r["histology_grade"], r["margin_status"] = rnd.choice("123"), rnd.choice("123")
            r["adjuvant_therapy"] = rnd.choice("123")
            r["follow_status"] = rnd.choice("1234")
            r["recurrence_site"] = rnd.choice("123") if r["follow_status"] == "2" else ""
            rows.append(r)
        for plan, value in ((BLANK, ""), (CODES, "-888")):
            for field, n in plan[site].items():
                filled = [r for r in rows if r[field] not in ("", "-888")]
                for r in rnd.sample(filled, n):
                    r[field] = value
        out += rows
    for i, r in enumerate(out, 1):
        r["syn_id"] = f"SYN-{i:04d}"
    return out


def frame(spark):
    return spark.createDataFrame([[r[c] for c in COLUMNS] for r in records()],
                                 ", ".join(f"{c} string" for c in COLUMNS))
