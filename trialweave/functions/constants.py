"""Fixed values of the study-data domain. They must equal the published conventions exactly."""

# Coded missing values an importer or annotator may write.
MISSING_CODES = ("-666", "-777", "-888", "-999")
# The same, plus the not-applicable code; used by worklists, Table 1 and the missingness profile.
SENTINELS = ("666", "-666", "-777", "-888", "-999")
# Date-shaped missing codes, as displayed (day first) and as imported (year first).
DATE_SENTINELS_DISPLAY = ("06-06-6666", "07-07-7777", "08-08-8888", "09-09-9999")
DATE_SENTINELS_IMPORT = ("6666-06-06", "7777-07-07", "8888-08-08", "9999-09-09")

# Phrases meaning "looked for, not in the chart".
MISSING_PHRASES = (
    "not found", "cannot be found", "could not be found", "can not be found",
    "no case note", "case note missing", "missing case note", "missing in case note",
    "case note not available", "case note unavailable", "not available in case note",
    "no case file", "case file not",
)
NOT_IN_NOTES_CODE = "-888"
NOT_IN_NOTES_DATE = "8888-08-08"

# Words that stand for "nothing here" in imported spreadsheets.
NULL_WORDS = ("none", "n/a", "na", "-", "nil", "nan")
DATE_NULL_WORDS = ("none", "n/a", "na", "-", "nil")

SITE_FIELD = "redcap_data_access_group"
UNASSIGNED = "unassigned"

FIELD_TYPES = (
    "text", "notes", "radio", "dropdown", "calc", "file", "checkbox", "yesno",
    "truefalse", "descriptive", "slider",
)
VALIDATION_TYPES = (
    "date_dmy", "date_mdy", "date_ymd", "datetime_dmy", "datetime_mdy", "datetime_ymd",
    "datetime_seconds_dmy", "datetime_seconds_mdy", "datetime_seconds_ymd",
    "email", "integer", "number", "phone", "time_hh_mm_ss", "time", "zipcode",
)
ALIGNMENTS = ("LV", "LH", "RV", "RH")
MISSING_CHOICE_TEXT = (
    "-666, Patient does not know", "-777, Patient refused to answer",
    "-888, Missing in case notes", "-999, Other missing",
)
TEXT_MISSING_NOTE = (
    "[-666, Patient does not know  -777, Patient refused to answer  "
    "-888, Missing in case notes  -999, Other missing (add comment for reason missing)]"
)
DATE_MISSING_NOTE = (
    "[06-06-6666, Patient does not know  07-07-7777, Patient refused to answer  "
    "08-08-8888, Missing in case notes  09-09-9999, Other missing "
    "(add comment for reason missing)]"
)
DATE_MISSING_MARK = "06-06-6666"
# A text missing-code mark that is not the tail of a longer number or date.
TEXT_MISSING_MARK = r"(?<![0-9-])-666"
MISSING_EXEMPT_TYPES = ("descriptive", "calc", "file")
MISSING_EXEMPT_FORMS = (
    "internal_tracking", "build_tracking", "study_metadata", "tracking", "library_record_id",
)
MISSING_EXEMPT_FIELDS = ("hospital_site", "hospital_number")

# Dictionary columns: designer header -> export key, in file order.
DICTIONARY_HEADERS = {
    "Variable / Field Name": "field_name",
    "Form Name": "form_name",
    "Section Header": "section_header",
    "Field Type": "field_type",
    "Field Label": "field_label",
    "Choices, Calculations, OR Slider Labels": "select_choices_or_calculations",
    "Field Note": "field_note",
    "Text Validation Type OR Show Slider Number": "text_validation_type_or_show_slider_number",
    "Text Validation Min": "text_validation_min",
    "Text Validation Max": "text_validation_max",
    "Identifier?": "identifier",
    "Branching Logic (Show field only if...)": "branching_logic",
    "Required Field?": "required_field",
    "Custom Alignment": "custom_alignment",
    "Question Number (surveys only)": "question_number",
    "Matrix Group Name": "matrix_group_name",
    "Matrix Ranking?": "matrix_ranking",
    "Field Annotation": "field_annotation",
}
DICTIONARY_COLUMNS = tuple(DICTIONARY_HEADERS.values())

# Marks of requests and builds.
DONE_VALUE = "Yes"
BUILD_STEPS = (
    "project_created", "dd_uploaded", "user_rights_complete", "data_imported",
    "review_internal", "review_pi", "study_production",
)
# Bookkeeping columns that say nothing about what a request is.
BOOKKEEPING_FIELDS = ("assigned_to", "assignment_date", "completed", "resolution_date", "notes")

# Research sub-categories: first pattern that matches title and description wins.
SUBCATEGORIES = (
    (r"\b(biobank|repository|biorepository|specimen.collection|tissue.bank)\b", "Repository"),
    (r"\b(qualitative|interview|focus.group|survey|questionnaire|behavioral|psychosocial)\b",
     "Behavioral or psychosocial research study"),
    (r"\b(clinical.trial|randomi[sz]ed|rct|phase.[i1234])\b", "Clinical research study or trial"),
    (r"\b(deep.learning|machine.learning|ai|algorithm|diagnostic|imaging.classifier)\b",
     "Translational research 1"),
    (r"\b(implementation|dissemination|capacity.building|training.evaluation)\b",
     "Translational research 2"),
    (r"\b(epidemiolog|incidence|prevalence|cohort.study|case.control|retrospective.review"
     r"|retroactive.review|outcomes.review)\b", "Epidemiology"),
    (r"\b(bench|molecular|single.cell|in.vitro|cell.line)\b", "Basic or bench research"),
)
SUBCATEGORY_UNCLEAR = "(unclear — ask user)"
HONORIFICS = ("dr", "prof", "mr", "mrs", "ms", "miss")

# Spreadsheet recode; study-specific tables (sheet to type, place to code) are parameters.
CANCER_TYPES = {
    "CRC": "1", "COLORECTAL": "1", "BREAST": "2", "GASTRIC": "3", "PROSTATE": "4",
    "HEPATOBILIARY": "5", "HPB": "5", "SARCOMA": "6", "MIXED": "7", "OTHER": "8",
}
ATTACHMENT_MARKS = (
    "quest_univ_file", "quest_site_", "sop", "eligibility_checklist", "irb_file_",
    "consent_file_", "consent_prof_",
)
