"""The three studies end to end, from CSV files to every output."""

import csv
from collections import Counter
from datetime import date, timedelta

import numpy as np
import pytest

from cohortsmith import sources
from cohortsmith.plans import incidence_study, serosurvey_study, symptom_study
from cohortsmith.plans.covariates import INFECTED
from cohortsmith.sources.schemas import SERO_BASELINE, SYMPTOMS

AGES = ["0-9", "10-19", "20-29", "30-39", "40-49"]
GROUP = dict(zip(AGES, ["0-17 years", "0-17 years", "18-49 years", ">=50 years",
                        ">=50 years"]))
SES = ["1. very low", "2. low", "3. med.", "4. high", "5. highest"]


def save(path, rows):
    with open(path, "w", encoding="utf-8", newline="") as f:
        writer = csv.DictWriter(f, rows[0].keys())
        writer.writeheader()
        for r in rows:
            writer.writerow({k: "NA" if v is None else v for k, v in r.items()})
    return str(path)


def case_rows(rng, n=700):
    out = []
    for i in range(n):
        onset = date(2020, 12, 20) + timedelta(int(rng.integers(0, 400)))
        swab = onset + timedelta(int(rng.integers(-1, 12)))
        age = str(rng.choice(AGES)) if rng.random() > 0.03 else None
        saturation = round(float(rng.uniform(90, 100)), 1) if rng.random() > 0.1 else None
        positive = rng.random() < 0.4
        row = {
            "individualid": f"p{int(rng.integers(0, 400))}", "visitid": f"v{i // 2}",
            "week": (onset - timedelta(onset.weekday())).isoformat(),
            "monthonset": onset.strftime("%Y-%m"),
            "testresult": None if rng.random() < 0.1 else
            ("positive" if positive else "negative"),
            "agegr10": age, "agegr": GROUP.get(age),
            "GENDER": str(rng.choice(["M", "F"])), "SesScoreQnt": str(rng.choice(SES)),
            "oxygen_saturation": saturation,
            "age": int(rng.integers(0, 50)),
            "datacolheita": swab.isoformat() if rng.random() > 0.1 else None,
            "data_inicio_sintomas": onset.isoformat(),
            "valorct": f"{rng.uniform(15, 38):.1f}" if positive else None,
        }
        for s in SYMPTOMS:
            p = 0.6 if positive and s in ("anosmia", "ageusia") else 0.35
            u = rng.random()
            row[s] = "Sim" if u < p else "Não" if u < 0.9 else (
                "Não sabe" if u < 0.95 else None)
        out.append(row)
    return out


def cohort_rows(rng, n=600):
    out = []
    for i in range(n):
        age = str(rng.choice(AGES))

        def yes_no(positive="Sim", negative="Não"):
            u = rng.random()
            return positive if u < 0.4 else negative if u < 0.95 else None

        out.append({
            "openhdsindividualId": f"p{i}", "locationid": f"h{i // 4}",
            "time": round(float(rng.integers(1, 480)) / 30, 4),
            "event": int(rng.random() < 0.25), "age": int(rng.integers(0, 60)),
            "agegr10": age, "agegr": GROUP[age], "sex": str(rng.choice(["M", "F"])),
            "SesScoreQnt": str(rng.choice(SES)),
            "education": str(rng.choice(["secondary", "primary", "higher"])),
            "health_worker": yes_no(), "toylet_sharing": yes_no(),
            "water_availability": yes_no(), "soap_availability": yes_no(),
            "smokingbin": yes_no("(ex-)smoker", "non smoker"),
            "hypertensionbin": int(rng.random() < 0.2),
            "diabetesbin": int(rng.random() < 0.2), "hivbin": int(rng.random() < 0.2),
            "overweight": str(rng.choice(["normal", "obesity", "overweight"])),
            "pregnant": str(rng.choice(["not", "pregnant"])),
            "bedroom_sharing": str(rng.choice(["1 a 2", "3 a 5"])),
            "handwash": yes_no(),
            "publictransport_pastweek": str(rng.choice(
                ["none", "bus/train", "moto taxi/shared taxi"])),
            "tbbin": str(rng.choice(["not", "(history of) tuberculosis"], p=[0.8, 0.2])),
            "lungdisease": str(rng.choice(["not", "asthma"])),
            "heart": str(rng.choice(["not", "heart disease"])),
            "leukemia": str(rng.choice(["not", "leukemia"], p=[0.8, 0.2])),
        })
    return out


def survey_rows(rng, n=350):
    answers = {
        "sex": ["M", "F"], "SesScoreQnt": SES, "mass_bus": ["Sim", "Não"],
        "main_bus": ["minibus", "moto taxi", "comboio", None],
        "ednivel_educacao": ["2. Primario completo", "4. Secundario completo",
                             "6. Superior"],
        "tb": ["Nao", "Sim, tuberculose"], "smoking": ["Nunca fumou", "Fumador actual"],
        "hypertension": ["Não", "Diagnosticado, em tratamento"],
        "diabet": ["Não", "Diagnosticado, em tratamento"],
        "cancer": ["Nao", "malignidade hematologica"],
        "hearth_diseases": ["Nao", "Diagnosticada"],
        "chronic_lung_disease": ["Nao", "asma"], "bedroom_sharing": ["1 a 2", "6 ou mais"],
        "water_availability": ["Disponivel", "Nao disponivel"],
    }
    out = []
    for i in range(n):
        age = str(rng.choice(AGES))
        own = {
            c: rng.choice(answers[c]) if c in answers else str(rng.choice(["Sim", "Não"]))
            for c in SERO_BASELINE
        }
        own |= {"agegr10": age, "agegr": GROUP[age]}
        start = date(2020, 12, 20) + timedelta(int(rng.integers(0, 90)))
        for visit in range(int(rng.integers(1, 4))):
            when = start + timedelta(90 * visit + int(rng.integers(0, 9)))
            row = {
                "pseudoID": f"s{i}", "datacolheita": when.isoformat(),
                "analyte21_S1S2": round(float(rng.uniform(0, 2)), 3),
                "analyte25_RBD": None if rng.random() < 0.03 else
                round(float(rng.uniform(0, 2)), 3),
                "analyte26_NP": round(float(rng.uniform(0, 2)), 3),
                "vacinated": "Sim, 1 dose" if rng.random() < 0.08 else "Não",
                "hiv": str(rng.choice(["Seropositivo", "estado desconhecido"])),
                "BMI": round(float(rng.uniform(15, 38)), 1),
                "age": int(rng.integers(0, 60)), "mean_n_contactos": visit + 1.0, **own,
            }
            out += [row, row | {"analyte26_NP": 0.0}] if rng.random() < 0.05 else [row]
    return out


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    rng = np.random.default_rng(2)
    folder = tmp_path_factory.mktemp("study")
    made = {"cases": case_rows(rng), "cohort": cohort_rows(rng), "survey": survey_rows(rng)}
    return {k: (save(folder / f"{k}.csv", v), v) for k, v in made.items()}


def run_all(outputs):
    return {name: make().collect() for name, make in outputs.items()}


def test_symptom_study(spark, files):
    path, raw = files["cases"]
    got = run_all(symptom_study.symptom_study(sources.read_cases(spark, path)))
    assert all(got.values())
    tested = [r for r in raw if r["testresult"]]
    assert {r["testresult"]: r["n"] for r in got["results"]} == {
        **Counter(r["testresult"] for r in tested), None: 0
    }
    profile = {
        (r["variable"], r["value"], r["testresult"]): r["n"] for r in got["symptoms"]
    }
    fever = Counter((r["fever"], r["testresult"]) for r in tested)
    assert {k[1:]: n for k, n in profile.items() if k[0] == "fever"} == fever
    assert len({k[0] for k in profile}) == 23
    assert len({r["model"] for r in got["or_symptoms"]}) == 20
    yes = {k: profile["anosmia", "Sim", k] for k in ("positive", "negative")}
    no = {
        k: sum(profile.get(("anosmia", v, k), 0) for v in ("Não", "Não sabe"))
        for k in ("positive", "negative")
    }
    ratio = yes["positive"] * no["negative"] / (yes["negative"] * no["positive"])
    fit = next(r for r in got["or_symptoms"] if r["term"] == "anosmia=1")
    assert fit["estimate"] == pytest.approx(ratio, rel=1e-7)
    assert fit["conf_low"] < ratio < fit["conf_high"]
    assert {r["model"] for r in got["or_last_era"]} == {
        "anosmia", "ageusia", "appitite_loss", "chills"
    }
    assert "anosmia:variant=omikron" in {r["term"] for r in got["or_anosmia_by_era"]}


def test_incidence_study(spark, files):
    cases = sources.read_cases(spark, files["cases"][0])
    cohort = sources.read_cohort(spark, files["cohort"][0])
    raw = files["cohort"][1]
    got = run_all(
        incidence_study.case_outputs(cases)
        | incidence_study.outcome_outputs(cohort, cases)
        | incidence_study.cohort_outputs(cohort, cases)
    )
    assert all(got.values())
    years = sum(r["time"] for r in raw) / 12
    events = sum(r["event"] for r in raw)
    overall = got["incidence"][0]
    assert overall["person_years"] == pytest.approx(years)
    assert overall["rate"] == pytest.approx(events / years)
    assert got["households"][0][:] == (150, 4.0)
    assert sum(r["n"] for r in got["outcomes"]) == 600
    sex = {r["category"]: r["total"] for r in got["univariable"] if r["variable"] == "sex"}
    assert sex == Counter(r["sex"] for r in raw)
    assert {r["variable"] for r in got["univariable"]} - {
        r["variable"] for r in got["univariable_stacked"]
    } == {"pregnant", "soap_availability"}
    assert len({r["model"] for r in got["hr_exposures"]}) == 15
    assert {r["term"] for r in got["hr_education"]} == {
        "education=higher", "education=primary", "sex=F", "agegr10=30-39",
        "agegr10=40-49",
    }
    assert {r["result"] for r in got["moving_average"]} == {
        "PCR negative cases", "PCR confirmed cases"
    }
    label = incidence_study.with_ci_label(
        incidence_study.cohort_outputs(cohort)["hr_age_sex"]()
    ).first()
    assert label["Combined_CI"].count("-") == 1


def test_visit_and_map_outputs(spark):
    visits = spark.createDataFrame(
        [(date(2021, 3, 1), "Sim", "a"), (date(2021, 3, 3), None, "b")],
        "contact_date date, respiratory_symptoms string, dateHHID string",
    )
    got = run_all(incidence_study.visit_outputs(visits))
    assert [r["n"] for r in got["weekly_visits"]] == [1, 1]
    points = spark.createDataFrame(
        [(32.6, -25.94, 3, "positive"), (32.6, -25.94, 4, None), (33.0, -25.94, 9, None)],
        "longitude double, latitude double, n int, testresult string",
    )
    cells = run_all(incidence_study.map_outputs(points, points))
    assert [r["n"] for r in cells["visits_per_cell"]] == [7]
    assert sorted(r["n"] for r in cells["cases_per_cell"]) == [1, 1]


def test_serosurvey_study(spark, files):
    path, raw = files["survey"]
    got = run_all(serosurvey_study.serosurvey_study(sources.read_serosurvey(spark, path)))
    assert all(got.values())
    kept = {
        (r["pseudoID"], r["datacolheita"]) for r in raw
        if r["analyte25_RBD"] is not None and r["datacolheita"] < "2021-08-01"
    }
    assert got["samples"][0]["n"] == len(kept)
    assert got["ever_positive"][0]["participants"] == len({k[0] for k in kept})
    main = {r["seroresultRBD_NP"]: r["n"] for r in got["results_seroresultRBD_NP"]}
    assert sum(main.values()) == len(kept) and main[INFECTED] > 0
    people = got["survival"]
    assert len({r["pseudoID"] for r in people}) == len(people)
    assert {r["overweight"] for r in people} == {
        "normal", "overweight", "obesity", "underweight"
    }
    sexes = [r for r in got["univariable"] if r["variable"] == "sex"]
    assert sum(r["total"] for r in sexes) == len(people)
    assert sum(r["pctcases"] for r in sexes) == pytest.approx(100)
    assert len({r["model"] for r in got["hr_behaviour"]}) == 9
    assert len({r["model"] for r in got["hr_health"]}) >= 8
    chart = [r for r in got["prevalence_chart"] if r["ci_low"] is not None]
    assert {r["seroresultRBD_NP"] for r in chart} == {INFECTED}
