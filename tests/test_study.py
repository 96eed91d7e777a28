"""The whole study on a small landed tree, and the registered queries' contract."""

import datetime
from types import SimpleNamespace

import pytest

import __spark_entry__ as contract
from filingscope.plans.study import Study
from filingscope.sources.filings import read_filings

ITEMS = ["1", "1A", "2", "7", "8", "9", "10"]


def submission(accession, filed, risk):
    contents = "\n".join(f"<p>Item {x}. Title</p>" for x in ITEMS)
    body = "\n".join(f"<p><b>Item {x}.</b> Title</p>\n<p>{risk if x == '1A' else 'plain text'}</p>" for x in ITEMS)
    return (
        f"<SEC-DOCUMENT>{accession}.txt : {filed}\n<html><head><title>x</title></head><body>{contents}\n{body}</body></html>"
        "\n<SEQUENCE>2\nexhibit"
    )


@pytest.fixture(scope="module")
def study(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("study")
    base = " ".join(f"word{chr(97 + i % 26)}" for i in range(100))
    for cik in ("0000000001", "0000000002"):
        for year in range(2005, 2010):
            accession = f"{cik}-{year % 100:02d}-000001"
            risk = base + " awful" * (year - 2005) if (cik, year) != ("0000000002", 2008) else "12 34"
            if (cik, year) == ("0000000002", 2009):
                text = "no items at all"
            else:
                text = submission(accession, f"{year}0310", risk)
            folder = root / "html" / cik / "10-K" / accession
            folder.mkdir(parents=True)
            (folder / "full-submission.txt").write_text(text)
    for year in (2006, 2007, 2008):
        accession = f"0000000003-{year % 100:02d}-000001"
        text = submission(accession, f"{year}0310", base)
        folder = root / "html" / "0000000003" / "10-K" / accession
        folder.mkdir(parents=True)
        (folder / "full-submission.txt").write_text(text.replace("Item 1A.", "Also") if year == 2007 else text)
        (folder / "item1A.txt").write_text("a split item is no filing")
    folder = root / "html" / "0000000003" / "10-K" / "notanaccession"
    folder.mkdir(parents=True)
    (folder / "full-submission.txt").write_text("x")
    run = Study(spark, str(root / "tables"))
    run.clean(read_filings(spark, str(root / "html")))
    run.split()
    lexicon = spark.createDataFrame([("awful", -2.0)], "word STRING, valence DOUBLE")
    run.compare(lexicon)
    return run


def test_similarity_rows(study):
    rows = study.table("similarity").orderBy("ticker", "date_a").collect()
    assert [(r.ticker[-1], r.date_a.year, r.distance) for r in rows] == [("1", 2007, 1), ("1", 2008, 1), ("1", 2009, 1), ("2", 2007, 1), ("2", 2008, 102)]
    assert rows[0].date_b == datetime.date(2006, 3, 10)
    assert rows[0].sentiment == 0.0 and rows[0].similarity == 1 - 1 / (rows[0].len_a + rows[0].len_b)


def test_rejected(study):
    found = sorted((r.cik[-1], r.accession[11:13], r.reason) for r in study.rejected().collect())
    reasons = {(c, r) for c, _, r in found}
    assert reasons == {
        ("1", "before_first_year"), ("2", "before_first_year"), ("3", "bad_accession"), ("3", "missing_section"),
        ("2", "no_headings"), ("2", "no_filing_date"),
    }


def test_every_landed_filing_is_kept_or_rejected(study, spark):
    landed = {(r.cik, r.accession) for r in read_filings(spark, study.root.replace("tables", "html")).collect()}
    kept = {(r.cik, r.accession) for r in study.table("items").filter("status = 'ok'").collect()}
    gone = {(r.cik, r.accession) for r in study.rejected().collect()}
    assert landed == kept | gone


def test_a_filing_without_the_section_does_not_join_its_neighbours(study):
    rows = study.table("similarity").filter("ticker = '0000000003'").collect()
    assert rows == []
    pairs = sorted(r.accession[11:13] for r in study.rejected().filter("reason = 'missing_section'").collect())
    assert pairs == ["07", "08"]


def test_labels_stay_text(study):
    assert dict(study.table("items").dtypes)["item_n"] == "string"


def test_coverage(study):
    assert {(r.cik[-1], r.year) for r in study.coverage().collect()} >= {("3", 2007)}


def test_panel(study, spark):
    returns = spark.createDataFrame(
        [("0000000001", datetime.date(2007 + i // 12, i % 12 + 1, 28), 0.01 * (i % 5)) for i in range(48)],
        "cik STRING, date DATE, ret DOUBLE",
    )
    rows = study.panel(returns).orderBy("date_a").collect()
    assert [r.date_a.year for r in rows] == [2007, 2008, 2009]
    assert rows[0].old_similarity is None and rows[1].old_similarity == rows[0].similarity
    assert rows[0].sim_below_70 == 0 and rows[0].inc_len == 1


def test_default_folder_is_the_sessions():
    def session(folder):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder))

    assert Study(session("/shared/")).root == "/shared/study"
    with pytest.raises(ValueError):
        Study(session(None))


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    df = contract.entry(spark)
    assert df.columns == ["ticker", "date_a", "date_b", "distance", "similarity", "len_a", "len_b", "sentiment"]
    assert df.count() > 0


def test_models_of_a_panel(spark, tmp_path):
    import numpy as np
    import pandas as pd
    from pyspark.sql import functions as F

    from filingscope.plans import models

    rng = np.random.default_rng(3)
    frame = pd.DataFrame({name: rng.normal(size=400) for name in models.REGRESSION_FEATURES} | {"id": range(400)})
    frame["ret_18"] = frame.similarity + rng.normal(size=400) / 10
    kept = Study(spark, str(tmp_path))
    scored = kept.model(spark.createDataFrame(frame), F.col("id"), trees=6, min_leaf=10)
    assert scored.count() == 400 and kept.table("predictions").filter("y_pred is null").count() == 0
    metrics = kept.table("metrics").first()
    assert metrics.r2 > 0.3 and metrics.oob_r2 > 0.3 and metrics.oob_rows <= metrics.rows < 400
    assert {"accuracy", "macro avg", "weighted avg", "very_negative"} <= {r["class"] for r in kept.table("report").collect()}
    assert kept.table("confusion").count() == 5
    assert [r.feature for r in kept.table("importances").orderBy("place").limit(1).collect()] == ["similarity"]
