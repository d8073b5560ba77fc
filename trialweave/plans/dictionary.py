"""The data dictionary as a driver-side model; hundreds of rows, never record data."""
from __future__ import annotations

import re
from dataclasses import dataclass, fields as dataclass_fields

from pyspark.sql import DataFrame, SparkSession

from ..functions import constants as K
from ..functions.text import checkbox_column, checkbox_spellings

YES_NO = {"0": "No", "1": "Yes"}
TRUE_FALSE = {"0": "False", "1": "True"}
CODED = ("radio", "dropdown", "yesno", "truefalse")
MAX_FIELDS = 100_000


@dataclass(frozen=True)
class Field:
    field_name: str
    form_name: str = ""
    section_header: str = ""
    field_type: str = "text"
    field_label: str = ""
    select_choices_or_calculations: str = ""
    field_note: str = ""
    text_validation_type_or_show_slider_number: str = ""
    text_validation_min: str = ""
    text_validation_max: str = ""
    identifier: str = ""
    branching_logic: str = ""
    required_field: str = ""
    custom_alignment: str = ""
    question_number: str = ""
    matrix_group_name: str = ""
    matrix_ranking: str = ""
    field_annotation: str = ""

    @property
    def validation(self) -> str:
        return self.text_validation_type_or_show_slider_number

    @property
    def is_date(self) -> bool:
        return self.validation.startswith("date")

    @property
    def is_checkbox(self) -> bool:
        return self.field_type == "checkbox"

    @property
    def label(self) -> str:
        cleaned = re.sub(r"\s+", " ", self.field_label).strip().rstrip(" ?.:;")
        return cleaned or self.field_name

    @property
    def choices(self) -> dict[str, str]:
        """Code to label, in dictionary order; yes/no fields carry theirs implicitly."""
        listed = {}
        for part in self.select_choices_or_calculations.split("|"):
            code, comma, label = part.partition(",")
            if comma:
                listed[code.strip()] = label.strip()
        if listed or self.field_type not in ("yesno", "truefalse"):
            return listed
        return dict(YES_NO if self.field_type == "yesno" else TRUE_FALSE)


class Dictionary:
    """An ordered set of fields; the first one is the record identifier."""

    def __init__(self, fields: list[Field]):
        self.fields = list(fields)
        self.by_name: dict[str, Field] = {}
        for field in self.fields:
            self.by_name[field.field_name] = field

    @classmethod
    def from_rows(cls, rows) -> "Dictionary":
        known = {f.name for f in dataclass_fields(Field)}
        out = []
        for row in rows:
            named = {K.DICTIONARY_HEADERS.get(k, k): v for k, v in dict(row).items()}
            out.append(Field(**{k: "" if v is None else str(v)
                                for k, v in named.items() if k in known}))
        return cls(out)

    @classmethod
    def from_frame(cls, frame: DataFrame) -> "Dictionary":
        """Collect one project's dictionary; refuses anything that is not dictionary-sized."""
        ordered = frame.orderBy("pos") if "pos" in frame.columns else frame
        rows = ordered.limit(MAX_FIELDS + 1).collect()
        if len(rows) > MAX_FIELDS:
            raise ValueError(f"more than {MAX_FIELDS} fields: this is not a data dictionary")
        return cls.from_rows(r.asDict() for r in rows)

    def __contains__(self, name: str) -> bool:
        return name in self.by_name

    def __getitem__(self, name: str) -> Field:
        return self.by_name[name]

    def get(self, name: str) -> Field | None:
        return self.by_name.get(name)

    @property
    def id_field(self) -> str:
        if not self.fields:
            raise ValueError("the dictionary has no fields, so no record identifier")
        return self.fields[0].field_name

    def choices(self, name: str) -> dict[str, str]:
        field = self.by_name.get(name)
        return field.choices if field else {}

    def levels(self, name: str, sentinels=K.SENTINELS) -> dict[str, str]:
        """The codes that are categories of the variable, in dictionary order."""
        return {c: t for c, t in self.choices(name).items() if c not in sentinels}

    def forms(self) -> list[str]:
        return list(dict.fromkeys(f.form_name for f in self.fields))

    def fields_of(self, forms) -> list[str]:
        wanted = set(forms)
        return [f.field_name for f in self.fields if f.form_name in wanted]

    def base_name(self, column: str) -> str:
        """The field a column belongs to: itself, or the checkbox it is an option of."""
        return column if column in self.by_name else column.split("___")[0]

    def option_columns(self, name: str, columns) -> dict[str, str]:
        """Option code to the column that holds it, for the options present in ``columns``."""
        present = list(columns)
        out = {}
        for code in self.choices(name):
            hit = next((c for c in checkbox_spellings(name, code) if c in present), None)
            if hit:
                out[code] = hit
        prefix = name + "___"
        for column in present:
            if column.startswith(prefix) and column not in out.values():
                tail = column[len(prefix):]
                code = "-" + tail[1:] if tail.startswith("_") else tail
                bare = "-" + code if "-" + code in self.choices(name) else code
                out.setdefault(bare, column)
        return out

    def columns_for(self, names, columns) -> list[str]:
        """Record columns needed for the fields, checkbox fields expanded to options."""
        present = set(columns)
        out: dict[str, None] = {}
        for name in names:
            base = self.base_name(name)
            field = self.by_name.get(base)
            if field is not None and field.is_checkbox:
                out.update(dict.fromkeys(self.option_columns(base, columns).values()))
            elif name in present:
                out[name] = None
        return list(out)

    def expected_columns(self) -> list[str]:
        """Every record column the dictionary implies, checkbox fields as option columns."""
        out = []
        for f in self.fields:
            if f.is_checkbox:
                out += [checkbox_column(f.field_name, c) for c in f.choices]
            else:
                out.append(f.field_name)
        return out

    def label_map(self, names=None, refuse_duplicates: bool = True) -> dict[str, str]:
        """Field to cleaned label; two fields under one label are refused by default."""
        chosen = self.fields if names is None else [self.by_name[n] for n in names
                                                    if n in self.by_name]
        out, owner = {}, {}
        for f in chosen:
            if refuse_duplicates and f.label in owner:
                raise ValueError(
                    f"fields {owner[f.label]!r} and {f.field_name!r} share the label {f.label!r}")
            owner[f.label] = f.field_name
            out[f.field_name] = f.label
        return out

    def with_missing_codes(self) -> "Dictionary":
        """Add missing-code choices or notes wherever the field type calls for them."""
        out = []
        for i, f in enumerate(self.fields):
            exempt = i == 0 or f.field_type in K.MISSING_EXEMPT_TYPES \
                or f.field_name in K.MISSING_EXEMPT_FIELDS
            values = {x.name: getattr(f, x.name) for x in dataclass_fields(Field)}
            if not exempt and f.field_type in ("radio", "dropdown", "checkbox"):
                have = f.select_choices_or_calculations.strip()
                extra = " | ".join(t for t in K.MISSING_CHOICE_TEXT if t not in have)
                values["select_choices_or_calculations"] = " | ".join(x for x in (have, extra) if x)
            elif not exempt and f.field_type in ("text", "notes") and not f.field_note:
                values["field_note"] = K.DATE_MISSING_NOTE if f.is_date else K.TEXT_MISSING_NOTE
            out.append(Field(**values))
        return Dictionary(out)

    def to_frame(self, spark: SparkSession) -> DataFrame:
        names = list(K.DICTIONARY_COLUMNS)
        schema = "pos long, " + ", ".join(f"{n} string" for n in names)
        rows = [(i, *[getattr(f, n) for n in names]) for i, f in enumerate(self.fields)]
        return spark.createDataFrame(rows, schema)
