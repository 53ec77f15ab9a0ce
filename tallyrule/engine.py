"""The engine: datasets become verified patterns, and inputs are answered or refused."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrule.operators import routing
from tallyrule.operators.search import QUICK, Effort, Library, build_library, grow
from tallyrule.sources.tables import Loaded, from_folder, load_domain


@dataclass
class Engine:
    """A Spark session, a library, and what was refused."""

    spark: SparkSession
    library: Library = field(default_factory=lambda: Library({}, ()))
    refused: dict[str, str] = field(default_factory=dict)

    @classmethod
    def boot(cls, spark: SparkSession, names: list[str], effort: Effort = QUICK) -> Engine:
        """An engine over built-in domains."""
        return cls._from(spark, {n: load_domain(spark, n) for n in names}, effort)

    @classmethod
    def from_csv_folder(cls, spark: SparkSession, folder: str, effort: Effort = QUICK) -> Engine:
        """An engine over a folder of CSV files."""
        return cls._from(spark, from_folder(spark, folder), effort)

    @classmethod
    def _from(cls, spark: SparkSession, loaded: dict[str, Loaded], effort: Effort) -> Engine:
        good = {n: (d.df, list(d.features)) for n, d in loaded.items() if d.ok}
        return cls(spark, build_library(good, effort=effort), {n: d.why for n, d in loaded.items() if not d.ok})

    def regrow(self, name: str, effort: Effort = QUICK) -> bool:
        """Whether growing a built-in domain again gives the same pattern."""
        d, old = load_domain(self.spark, name), self.library.patterns.get(name)
        return bool(d.ok and old and grow(d.df, name, list(d.features), effort=effort).pattern_id == old.pattern_id)

    def think(self, inputs: DataFrame) -> DataFrame:
        """Answers from the best pattern of the library."""
        return routing.answer(inputs, list(self.library.patterns.values()))

    def skill(self, name: str, inputs: DataFrame) -> DataFrame:
        """Answers from one domain's pattern alone; it abstains on what is not its own."""
        p = self.library.patterns.get(name)
        return routing.answer(inputs, [p] if p else [])

    def first_verified(self) -> str | None:
        return next(iter(self.library.patterns), None)

    def status(self) -> DataFrame:
        """One row a pattern or refusal."""
        rows = [(n, p.held_auc, p.held, True, "") for n, p in self.library.patterns.items()]
        rows += [(c["domain"], c["heldAuc"], 0, False, c["why"]) for c in self.library.cut]
        rows += [(n, None, 0, False, why) for n, why in self.refused.items()]
        return self.spark.createDataFrame(rows, "domain string, held_auc double, held long, verified boolean, why string").orderBy(F.desc("verified"), "domain")
