"""The learnt part of the personal data operator: disguised spans of fresh values, and spoilt ones."""

import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from shelfcast.llm import pii  # noqa: E402
from shelfcast.session import build_session  # noqa: E402


@pytest.fixture(scope="module")
def spark():
    return build_session("llm-tests", master="local[4]", shuffle_partitions=4, driver_memory="4g")


@pytest.fixture(scope="module")
def model(spark):
    return pii.fit_personal(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def luhn(d):
    return sum(v if i % 2 == 0 else (2 * v) // 10 + (2 * v) % 10 for i, v in enumerate(map(int, reversed(d)))) % 10 == 0


def test_a_model_is_fitted_for_every_kind(spark, model):
    assert len(model.trees) == pii.TREES and all(0.5 <= t <= 1 for t in model.thresholds)
    few = pii.fit_personal(spark.createDataFrame([(1, "no data at all")], "doc_id long, text string"))
    assert few is not None and pii.fit_personal(spark.createDataFrame([], "doc_id long, text string")) is None


def test_the_model_does_not_depend_on_partitions(spark, model):
    again = pii.fit_personal(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(7))
    assert again.thresholds == model.thresholds
    assert str(again.probability(F.col("f"))._jc) == str(model.probability(F.col("f"))._jc)


def test_added_spans_are_right(spark, model):
    r = random.Random(11)
    number = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    good, bad = [], []
    for i in range(60):
        user, host = f"{r.choice('kmzt')}{number(2)}.x", f"srv{i}"
        good += [f"{user} [at] {host}.example.net", f"{user} (at) {host} (dot) example (dot) net", f"{user} at {host} dot example dot net"]
        ip = [r.randint(1, 255) for _ in range(4)]
        good += [sep.join(map(str, ip)) for sep in (" . ", "[.]", " dot ")]
        bad += [sep.join(map(str, [ip[0], ip[1], 256 + ip[2], ip[3]])) for sep in (" . ", "[.]")]
        card = "4" + number(14)
        card += next(d for d in "0123456789" if luhn(card + d))
        off = card[:-1] + str((int(card[-1]) + 1) % 10)
        good += [".".join(card[k:k + 4] for k in range(0, 16, 4)), "/".join(card[k:k + 4] for k in range(0, 16, 4))]
        bad += [off, ".".join(off[k:k + 4] for k in range(0, 16, 4)), f"20{number(2)}-05-11", f"{r.randint(1, 9)} 000 000", f"{number(3)}-{number(4)}", f"was at home. {host}"]
        good += [f"({r.randint(200, 999)}) {number(3)}-{number(4)}"]
    rows = [(i, f"so it was {v} and on") for i, v in enumerate(good + bad)]
    right = wrong = 0
    for row in pii.find_personal(spark.createDataFrame(rows, "doc_id long, text string"), model=model).collect():
        v = (good + bad)[row["doc_id"]]
        base = {(s["start"], s["end"]) for s in row["all_spans"] if row["base_sha256"] and any(row[f"n_{k}"] for k in pii.KINDS)}
        added = [s for s in row["all_spans"] if (s["start"], s["end"]) not in base]
        if row["doc_id"] < len(good):
            right += any(s["hit"] == v for s in added) or bool(base)
            wrong += sum(s["hit"] != v for s in added)
        else:
            wrong += len(added)
    assert right >= 0.95 * len(good) and wrong <= 0.02 * right, (right, len(good), wrong)


def test_clashing_columns_null_and_repeated_ids(spark, model):
    mail = "kim.7 (at) mail3 (dot) example (dot) org"
    rows = [(None, mail, "k"), (None, mail, "k"), (3, None, "k"), (3, "", "k"), (4, "x" * 200_000 + " 10 . 20 . 30 . 40", "k")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, base string, spans int, n_ip int")
    got = sorted((repr(r["doc_id"]), r["spans"]) for r in pii.find_personal(df, model=model).collect())
    assert got == sorted([("None", f"email:0:{len(mail)}"), ("None", f"email:0:{len(mail)}"), ("3", ""), ("3", ""), ("4", "ip:200001:200018")])


def test_all_documents_are_learnt_from(spark, monkeypatch):
    monkeypatch.setattr(pii, "fit_spans", lambda rows: rows)
    docs = spark.range(25_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("so 123-4567 and, for "), "id", F.lit(" of us, +1 (555) 010-"), F.lpad((F.col("id") % 10_000).cast("string"), 4, "0")).alias("text"))
    rows = pii.fit_personal(docs)
    assert rows.count() < rows.agg(F.sum("weight")).first()[0] / 2  # equal rows are one row with a weight
    none = pii.fit_personal(docs.where("doc_id < 0").unionByName(spark.createDataFrame([(1, "no data at all")], docs.schema)))
    total = lambda r, label: r.where(F.col("label") == label).agg(F.sum("weight")).first()[0]
    assert total(rows, 1.0) - total(none, 1.0) >= 3 * 25_000  # disguises of every document's number
    plain = rows.where("label = 0 and kind = 3 and digits = 7 and plus = 0 and chars = 8")
    assert plain.agg(F.sum("weight")).first()[0] >= 25_000
