"""Virtual raters: resume after a kill, each case asked once, errors, and the whole study."""

import json
import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from cohortlens.plans import api, raters as A

# workers don't have the tests' folder on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
FIELDS = ["text_adequate", "is_ftld_spectrum", "is_ppa"]


class Counting:
    """Answers from the packet's text and notes every question in a folder that all tasks share."""

    def __init__(self, folder, name, flip=()):
        self.folder, self.name, self.flip = str(folder), name, set(flip)

    def label(self, packet):
        with open(f"{self.folder}/{self.name}-{packet}", "a") as f:
            f.write("x")
        if packet == "bad" and not os.path.exists(f"{self.folder}/mended"):
            raise OSError("no answer")
        n = int(packet) if packet.isdigit() else 0
        return "so: " + json.dumps({"text_adequate": 1 if n % 5 else "", "is_ftld_spectrum": 1, "is_ppa": int((n % 2 == 0) != (n in self.flip))})


def asked(folder):
    return {f: os.path.getsize(f"{folder}/{f}") for f in os.listdir(folder) if f != "mended"}


def test_loop_resumes_and_asks_once(spark, tmp_path, monkeypatch):
    notes, out = tmp_path / "notes", f"{tmp_path}/log"
    notes.mkdir()
    cases = spark.createDataFrame([(f"c{i}", str(i)) for i in range(30)] + [("c3", "3"), ("e", "bad"), (None, "9")], "case_uid string, packet string")
    raters = {"r1": Counting(notes, "r1"), "r2": Counting(notes, "r2")}
    # killed after half of the parts
    kept, n = A.answers, []

    def dies(*a):
        n.append(1)
        if len(n) > 4:
            raise KeyboardInterrupt
        return kept(*a)

    monkeypatch.setattr(A, "answers", dies)
    with pytest.raises(KeyboardInterrupt):
        A.rate_cases(cases, raters, out, parts=8)
    monkeypatch.setattr(A, "answers", kept)
    half = len(asked(notes))
    assert 0 < half < 62
    found = A.rate_cases(cases, raters, out, parts=8)
    assert found.count() == 62 and set(asked(notes).values()) == {1} and len(asked(notes)) == 62
    sheet = {r.case_uid: r for r in A.filled_sheet(found, "r1", FIELDS).collect()}
    assert sheet["e"].error == "OSError: no answer" and sheet["c5"].text_adequate == 0 and sheet["c5"].is_ppa is None and sheet["c4"].is_ppa == 1
    # failed cases only when asked for
    (notes / "mended").touch()
    A.rate_cases(cases, raters, out, parts=2)
    assert asked(notes)["r1-bad"] == 1
    again = A.rate_cases(cases, raters, out, parts=2, retry_errors=True)
    assert asked(notes)["r1-bad"] == 2 and again.where("error IS NOT NULL").count() == 0 and sum(asked(notes).values()) == 64
    assert A.rate_cases(cases.where("false"), raters, f"{tmp_path}/none", parts=2).count() == 0


def test_study_asks_the_judge_about_disagreements_only(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    packets = spark.createDataFrame([(f"c{i}", str(i)) for i in range(24)], "case_uid string, packet string")
    cases = packets.select("case_uid", F.when(F.col("packet").cast("int") % 3 == 0, "discovery").otherwise("confirmation").alias("split"), (F.col("packet").cast("int") % 4).alias("cluster_matched"), F.lit(False).alias("is_ppa"), F.lit("x").alias("ftld_syndrome_reported"))
    study = api.virtual_rater_study(cases, packets, Counting(notes, "a"), Counting(notes, "b", {4, 7}), Counting(notes, "j"), f"{tmp_path}/out", FIELDS)
    assert {f for f in asked(notes) if f.startswith("j-")} == {"j-4", "j-7"}
    done = {r.case_uid: r for r in study["consensus"].collect()}
    assert done["c4"].is_ppa == 1 and done["c7"].is_ppa == 0 and done["c6"].is_ppa == 1
    assert {r.case_uid for r in study["cases"].where("is_ppa").collect()} == {f"c{i}" for i in range(0, 24, 2) if i % 5}
    assert study["pooled_primary_precision"].count() == 12
    with pytest.raises(ValueError):
        api.virtual_rater_study(cases, packets, Counting(notes, "a"), Counting(notes, "b", {4, 7}), Counting(notes, "j"), f"{tmp_path}/out", FIELDS, force=False, p=0.5, share=0.1, baseline=0.2)
    assert set(asked(notes).values()) == {1}
