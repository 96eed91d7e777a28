"""The stages put together, each handing a table to the next."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filingscope import schemas
from filingscope.functions.dates import accession_year
from filingscope.functions.ordered import latest_per_key, stored
from filingscope.operators import evaluation
from filingscope.operators import similarity as sim
from filingscope.operators.audit import coverage_gaps
from filingscope.operators.headings import repair_headings
from filingscope.operators.html_text import html_to_text
from filingscope.operators.pairs import clean_pairs, consecutive_pairs
from filingscope.operators.panel import build_panel, labelled, with_features
from filingscope.operators.quantiles import QUINTILE_LABELS, with_quintiles
from filingscope.operators.returns import link_returns
from filingscope.operators.sections import filing_date, rejects, sections, split_items
from filingscope.plans import bagging, models
from filingscope.session import shared_folder
from filingscope.sources.filings import FIRST_YEAR, START_DATE, filed_from, landing_rejects, usable_filings
from filingscope.sources.index import filer_list, only_filers
from filingscope.sources.tables import write_parquet

RISK_ITEM = "1A"
# Files that one item label is written to at most in a run.
FILES_PER_ITEM = 64


def clean_filings(raw: DataFrame) -> DataFrame:
    """Raw filings to text with repaired headings and the filing date."""
    text = repair_headings(html_to_text(raw, body="body", into="text"))
    return text.withColumn("filed_date", filing_date(F.col("text"), F.col("accession"))).select(
        "cik", "accession", "filed_date", "text"
    )


# Tables are read with these schemas: a partition column's type would otherwise be guessed from its values.
STAGE_SCHEMAS = {
    "landing_rejects": schemas.REJECTS,
    "filings_clean": schemas.FILINGS_CLEAN,
    "items": schemas.ITEMS,
    "similarity": schemas.SIMILARITY,
    "pair_rejects": schemas.REJECTS,
    "returns": schemas.RETURNS,
}


@dataclass
class Study:
    """Table locations below one folder that all executors reach; by default the session's own."""

    spark: SparkSession
    root: str | None = None

    def __post_init__(self) -> None:
        if self.root is None:
            self.root = f"{shared_folder(self.spark)}/study"

    def table(self, name: str) -> DataFrame:
        reader = self.spark.read
        if name in STAGE_SCHEMAS:
            reader = reader.schema(STAGE_SCHEMAS[name])
        return reader.parquet(f"{self.root}/{name}")

    def _write(self, name: str, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        write_parquet(df, f"{self.root}/{name}", partition_by)
        return self.table(name)

    def index(self, index_rows: DataFrame) -> DataFrame:
        """The expected filers of parsed index rows, one row each, for `coverage` and `returns`."""
        return self._write("filers", filer_list(index_rows))

    def clean(
        self, raw: DataFrame, first_year: int = FIRST_YEAR, latest: int | None = None, ciks: Sequence[str] | None = None
    ) -> DataFrame:
        """Cleaned filings; `latest` keeps only so many of each filer, the newest by accession year and number, `ciks` only these filers."""
        if ciks is not None:
            raw = only_filers(raw, ciks)
        self._write("landing_rejects", landing_rejects(raw, first_year))
        kept = usable_filings(raw, first_year)
        if latest is not None:
            newest = [F.desc(accession_year(F.col("accession"))), F.desc("accession")]
            kept = kept.join(
                latest_per_key(kept.select("cik", "accession"), ["cik"], newest, latest), ["cik", "accession"], "left_semi"
            )
        return self._write("filings_clean", clean_filings(kept))

    def split(self, rounds: str = "previous", last_line: int | None = None) -> DataFrame:
        """All items of dated filings; failures share the table under their own partition."""
        items = split_items(self.table("filings_clean"), rounds, last_line)
        # Rows of a label meet in a few tasks, so that a label has a few files and not one of each task.
        parts = items.repartition("item_n", F.pmod(F.xxhash64("cik", "accession"), F.lit(FILES_PER_ITEM)))
        return self._write("items", parts, partition_by="item_n")

    def _pairs(self) -> DataFrame:
        """Consecutive filings of all that have a date, whether they have the section or not."""
        return consecutive_pairs(filed_from(self.table("filings_clean"), START_DATE))

    def compare(self, lexicon: DataFrame, item: str = RISK_ITEM, basis: str = "longer") -> DataFrame:
        items = sections(self.table("items"), item)
        pairs = self._pairs()
        failed = sim.pair_rejects(items, pairs).select("cik", F.col("filing_a").alias("accession"), "reason")
        self._write("pair_rejects", failed)
        return self._write("similarity", sim.compare_sections(items, pairs, lexicon, basis))

    def rejected(self) -> DataFrame:
        """Everything a stage left out, with the reason. A rejected pair carries its newer filing."""
        failed = rejects(self.table("items")).select("cik", "accession", "reason")
        clean = self.table("filings_clean")
        undated = clean.filter(F.col("filed_date").isNull() | (F.col("filed_date") < F.lit(START_DATE).cast("date")))
        reason = F.when(F.col("filed_date").isNull(), "no_filing_date").otherwise("before_start")
        return (
            self.table("landing_rejects")
            .unionByName(failed)
            .unionByName(undated.select("cik", "accession", reason.alias("reason")))
            .unionByName(self.table("pair_rejects"))
        )

    def coverage(self) -> DataFrame:
        """Filer and year of landed filings that no compared pair covers."""
        return self._write("coverage", coverage_gaps(self.table("filings_clean"), self.table("similarity")))

    def returns(self, stock: DataFrame, links: DataFrame, companies: DataFrame, filers: DataFrame | None = None) -> DataFrame:
        return self._write("returns", link_returns(stock, links, companies, filers))

    def panel(self, returns: DataFrame) -> DataFrame:
        rows = build_panel(clean_pairs(self.table("similarity")), returns)
        self._write("panel", rows)
        return with_features(self.table("panel"))

    def model(self, panel: DataFrame, key: Column, trees: int = models.TREES, min_leaf: int = models.MIN_LEAF) -> DataFrame:
        """Fit on the panel and keep what the fit says: tables `predictions`, `metrics`, `report`, `confusion` and `importances`.

        Returns are predicted by a forest with known bags, so metrics are of the test rows and of rows out of the bag; return classes, quintiles
        of the panel, by a classification forest, reported on its test rows. `key` names a row and decides where it falls.
        """
        rows = models.with_test_flag(panel, key)
        forest = bagging.fit_forest(rows, key, models.REGRESSION_FEATURES, models.LABEL, trees, min_leaf=min_leaf)
        scored = self._write("predictions", forest.score(rows, key))
        tests = evaluation.regression_metrics(scored.filter("is_test"), models.LABEL, "y_pred")
        self._write("metrics", tests.crossJoin(F.broadcast(bagging.oob_r2(scored, models.LABEL))))
        classed = labelled(with_quintiles(panel))
        classed = models.assemble(models.with_stratified_test_flag(classed, key, models.CLASS_LABEL), models.CLASSIFICATION_FEATURES, models.CLASS_LABEL)
        fitted = models.fit(models.classifier(trees=trees, min_leaf=min_leaf), classed)
        tested = models.score(fitted, classed.filter("is_test")).withColumn(models.CLASS_LABEL, F.col(models.CLASS_LABEL).cast("int"))
        tested = stored(tested.select(models.CLASS_LABEL, F.col("y_pred").cast("int").alias("y_pred")))
        self._write("report", evaluation.classification_report(tested, models.CLASS_LABEL, "y_pred", QUINTILE_LABELS))
        self._write("confusion", evaluation.confusion_matrix(tested, models.CLASS_LABEL, "y_pred", list(range(len(QUINTILE_LABELS)))))
        self._write("importances", models.feature_importances(fitted, models.CLASSIFICATION_FEATURES, classed))
        return scored
