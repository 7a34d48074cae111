"""The clinical tables, end to end on a handful of patients."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import clinical
from cohortlens.operators import cleaning, cohort, endpoints, features, survival
from cohortlens.plans.flows import time_to_crossing
from cohortlens.sources import DOMAIN_SCHEMAS, load, write_table

DAY = dt.datetime(2015, 1, 1)


def echo_rows():
    """Patient a deteriorates and stays so; b rises once and falls back; c stays well."""
    plan = {"a": [10, 12, 30, 32, 33], "b": [10, 31, 12, 11, 12], "c": [9, 10, 10, 11, 10]}
    area = {"a": [1.6, 1.6, 1.1, 1.0, 1.0], "b": [1.6, 1.1, 1.6, 1.6, 1.6], "c": [1.7] * 5}
    for p in plan:
        for i, (g, e) in enumerate(zip(plan[p], area[p])):
            value, unit = (g * clinical.CMH2O_PER_MMHG, "cmH2O") if i == 2 else (float(g), "mmHg")
            yield (p, DAY + dt.timedelta(days=365 * i), "r1", value, unit, 2.0, e, f"mean gradient {g} mmHg")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("clinic"))
    echo = spark.createDataFrame(list(echo_rows()), DOMAIN_SCHEMAS["echo"])
    people = [(p, s, 1940, "f", None, 170.0, 70.0, ["x"], []) for p, s in zip("abc", "SST")]
    write_table(echo.unionByName(echo.limit(1)), f"{folder}/echo.parquet")
    spark.createDataFrame(people, DOMAIN_SCHEMAS["patient"]).write.json(f"{folder}/patient.json")
    return folder


def test_stages_and_survival(spark, folder):
    echo = cleaning.dedup(load(spark, folder, "echo"), ["patient_id", "visit_ts"], ["reader"])
    echo = cleaning.normalize_units(echo, "mean_gradient", "gradient_unit", clinical.PRESSURE_TO_MMHG, "mmHg")
    order = ["visit_ts"]
    index = cohort.index_event(echo, "patient_id", "visit_ts", ["mean_gradient", "eoa_cm2"])
    changed = features.from_baseline(echo, index, id="patient_id", x="mean_gradient", baseline="index_mean_gradient", keep=["index_eoa_cm2"])
    staged = endpoints.stage(changed, x="mean_gradient", change="mean_gradient_change", corroborating="eoa_cm2",
                             baseline_corroborating="index_eoa_cm2", rules=clinical.STAGE_RULES)
    flagged = staged.withColumn("flag", (F.col("stage") >= 2).cast("int"))
    first = endpoints.first_event(flagged, "patient_id", order, "flag", confirm=1)
    assert [r.patient_id for r in first.collect()] == ["a"]
    table = endpoints.survival_table(index, first, echo, id="patient_id", index="index_visit_ts", event_t="event_t", last_t="visit_ts")
    got = {r.patient_id: (r.time, r.event) for r in table.collect()}
    assert got == {"a": (730, 1), "b": (1460, 0), "c": (1460, 0)}
    assert [round(r.survival, 6) for r in survival.km(table).orderBy("time").collect()] == [0.666667, 0.666667]


def test_flow_on_clinical_tables(spark, folder):
    echo = cleaning.normalize_units(load(spark, folder, "echo"), "mean_gradient", "gradient_unit", clinical.PRESSURE_TO_MMHG, "mmHg")
    people = load(spark, folder, "patient", fmt="json")
    table = time_to_crossing(echo, people, id="patient_id", order=["visit_ts"], x="mean_gradient", rise=10.0, level=20.0, keep=["site"])
    got = {r.patient_id: (r.site, r.n_visits, r.time, r.event) for r in table.collect()}
    assert got == {"a": ("S", 5, 730, 1), "b": ("S", 5, 365, 1), "c": ("T", 5, 1460, 0)}


def test_measures_in_reports(spark, folder):
    found = cleaning.extract_measures(load(spark, folder, "echo"), "report", {"gradient": r"gradient ([0-9.]+) mmHg"}, ["patient_id", "visit_ts"])
    assert found.count() == 16 and found.where("value IS NULL").count() == 0


def test_unknown_sources_are_refused(spark, folder):
    with pytest.raises(KeyError):
        load(spark, folder, "nothing")
    with pytest.raises(ValueError):
        load(spark, folder, "echo", fmt="xlsx")


def test_csv_source(spark, folder, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame([("a", "x", 3)], DOMAIN_SCHEMAS["score"]).write.option("header", True).csv(f"{path}/score.csv")
    assert load(spark, path, "score", fmt="csv").collect()[0].score == 3
