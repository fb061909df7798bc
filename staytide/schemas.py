"""Column groups, input schemas and source descriptions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql.types import (
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

# Feature names and their order, as the trained models expect them.
MEASURES = ["m1_valuenum", "m2_valuenum"]
DEMOGRAPHICS = ["gender", "age"]
COMORBIDITY = [
    "mi", "chf", "pvd", "cevd", "dementia", "cpd", "rheumd", "pud", "mld",
    "diab", "diabwc", "hp", "rend", "canc", "msld", "metacanc", "aids", "CCI",
]
BODY = ["height", "weight", "bmi"]
BODY_AVAILABLE = ["height_avail", "weight_avail", "bmi_avail"]
ORGAN_SCORES = [
    "respiration", "coagulation", "liver", "cardiovascular", "cns", "renal", "sofa_total",
]
VENTILATION = ["mv_invasive", "mv_non_vasive", "mv_oxygen_therapy", "mv_none", "mv_unknown"]
RACE = ["race_w", "race_b", "race_l", "race_o"]

FEATURES = (
    MEASURES + DEMOGRAPHICS + COMORBIDITY + BODY + BODY_AVAILABLE + ORGAN_SCORES + VENTILATION + RACE
)

# How a stay's rows become one feature row: the middle value, or the first value seen.
MEDIAN_FEATURES = ["m1_valuenum", "m2_valuenum", "age", "height", "weight", "bmi"]
COLLAPSE = {name: "median" if name in MEDIAN_FEATURES else "first" for name in FEATURES}

# Hours of the outcome labels.
HORIZON_HOURS = [6, 12, 24, 48, 72, 96, 120, 144, 168, 192, 216, 240, 7200]

HOUR_US = 3_600_000_000
MINUTE_US = 60_000_000


_TYPES = {
    "BIGINT": LongType(),
    "INT": IntegerType(),
    "DOUBLE": DoubleType(),
    "STRING": StringType(),
    "BOOLEAN": BooleanType(),
    "TIMESTAMP_NTZ": TimestampNTZType(),
}


def _schema(columns: str) -> StructType:
    pairs = [c.split() for c in columns.split(",")]
    return StructType([StructField(name, _TYPES[kind]) for name, kind in pairs])


# Declared input schemas; a CSV scan never infers types.
_SCORES = ", ".join(f"imputed_{c} DOUBLE" for c in ORGAN_SCORES[:-1]) + ", sofa_total DOUBLE"
_FLAGS = ", ".join(f"{c} INT" for c in COMORBIDITY)

INPUT_SCHEMAS: dict[str, StructType] = {
    # offsets in minutes from admission
    "nurse_charting": _schema(
        "patientunitstayid BIGINT, nursingchartoffset BIGINT, nursingchartcelltypevalname STRING, "
        "nursingchartcelltypevallabel STRING, nursingchartvalue STRING"
    ),
    "respiratory_charting": _schema(
        "patientunitstayid BIGINT, respchartoffset BIGINT, respchartentryoffset BIGINT, "
        "respchartvaluelabel STRING, respchartvalue STRING"
    ),
    "treatment": _schema(
        "patientunitstayid BIGINT, treatmentoffset BIGINT, treatmentstring STRING, "
        "activeupondischarge BOOLEAN"
    ),
    "patient": _schema(
        "patientunitstayid BIGINT, patienthealthsystemstayid BIGINT, uniquepid STRING, gender STRING, "
        "age STRING, ethnicity STRING, admissionheight DOUBLE, admissionweight DOUBLE, "
        "hospitaladmitoffset BIGINT, hospitaldischargestatus STRING, hospitaldischargeoffset BIGINT, "
        "unitdischargeoffset BIGINT, unitdischargestatus STRING, unitstaytype STRING"
    ),
    "unit_comorbidity": _schema(f"patientunitstayid BIGINT, {_FLAGS}"),
    "unit_scores": _schema(f"patientunitstayid BIGINT, startoffset BIGINT, endoffset BIGINT, {_SCORES}"),
    # timestamps
    "icustays": _schema(
        "subject_id BIGINT, hadm_id BIGINT, stay_id BIGINT, intime TIMESTAMP_NTZ, outtime TIMESTAMP_NTZ, "
        "los DOUBLE"
    ),
    "patients": _schema("subject_id BIGINT, gender STRING"),
    "age": _schema("subject_id BIGINT, hadm_id BIGINT, age DOUBLE"),
    "hospital_comorbidity": _schema(f"index BIGINT, hadm_id BIGINT, {_FLAGS}"),
    "height": _schema("subject_id BIGINT, stay_id BIGINT, height DOUBLE"),
    "weight_duration": _schema(
        "stay_id BIGINT, starttime TIMESTAMP_NTZ, endtime TIMESTAMP_NTZ, weight DOUBLE"
    ),
    "stay_scores": _schema(
        f"stay_id BIGINT, starttime TIMESTAMP_NTZ, endtime TIMESTAMP_NTZ, {_SCORES}"
    ),
    "hourly_ventilation": _schema(
        "subject_id BIGINT, stay_id BIGINT, hourly_timestamp TIMESTAMP_NTZ, MV_new_5_categories STRING"
    ),
    "admissions": _schema(
        "subject_id BIGINT, hadm_id BIGINT, admittime TIMESTAMP_NTZ, dischtime TIMESTAMP_NTZ, "
        "deathtime TIMESTAMP_NTZ, race STRING, hospital_expire_flag INT"
    ),
    "chartevents": _schema(
        "subject_id BIGINT, hadm_id BIGINT, stay_id BIGINT, charttime TIMESTAMP_NTZ, itemid INT, "
        "valuenum DOUBLE"
    ),
    # named events
    "demographics": _schema(
        "MRN BIGINT, FIN BIGINT, Deceased TIMESTAMP_NTZ, DOB TIMESTAMP_NTZ, Race STRING, Ethnicity STRING, "
        "Sex STRING, ht DOUBLE, wt DOUBLE, bmi_cal DOUBLE, HTN_patient STRING, ArriveDTS TIMESTAMP_NTZ, "
        "DischargeDTS TIMESTAMP_NTZ"
    ),
    "vitals": _schema("MRN BIGINT, FIN BIGINT, EventDT TIMESTAMP_NTZ, Event STRING, Result DOUBLE"),
    # ready-made cohort lists
    "unit_cohort": _schema("patientunitstayid BIGINT, dead24 INT"),
    "stay_cohort": _schema("stay_id BIGINT, dead24 INT"),
}


@dataclass(frozen=True)
class Measurement:
    """How a source marks one measurement, and which values are plausible."""

    codes: tuple = ()
    contains: str | None = None
    low: float | None = None
    high: float | None = None


@dataclass(frozen=True)
class Source:
    """Column names and units of one source; the operators take them as arguments."""

    keys: tuple[str, ...]
    time: str
    code: str
    value: str
    unit: str  # "minutes" from admission, or "timestamp"
    missing_ventilation: str  # one-hot column that stands for "no interval"
    m1: Measurement = field(default_factory=Measurement)
    m2: Measurement = field(default_factory=Measurement)


# Item codes, names and plausible ranges per source.
SOURCES = {
    "minutes": Source(
        keys=("patientunitstayid",),
        time="nursingchartoffset",
        code="nursingchartcelltypevalname",
        value="nursingchartvalue",
        unit="minutes",
        missing_ventilation="mv_none",
        m1=Measurement(codes=("Heart Rate",), high=300),
        m2=Measurement(codes=("Non-Invasive BP Systolic", "Invasive BP Systolic"), low=30, high=300),
    ),
    "timestamps": Source(
        keys=("stay_id",),
        time="charttime",
        code="itemid",
        value="valuenum",
        unit="timestamp",
        missing_ventilation="mv_unknown",
        m1=Measurement(codes=(220045,), high=300),
        m2=Measurement(codes=(220179, 220050, 225309), low=30, high=300),
    ),
    "named": Source(
        keys=("MRN", "FIN"),
        time="EventDT",
        code="Event",
        value="Result",
        unit="timestamp",
        missing_ventilation="mv_unknown",
        m1=Measurement(contains="heart rate"),
        m2=Measurement(contains="systolic blood pressure"),
    ),
}
