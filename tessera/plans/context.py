"""What all layers of a build share: frames with their column groups, pinned column levels and header counts."""

from __future__ import annotations

import atexit
import itertools
import re
import shutil
import tempfile
import warnings
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.options import Options
from tessera.spec import CustomGroup, TableSpec, TotalGroup

SYNTHETIC = "__synthetic_"
#: Combinations of column levels that a table may have.
MOST_COLUMNS = 10_000


def metadata_levels(df: DataFrame, var: str) -> list[str] | None:
    if var in df.columns and "levels" in (meta := df.schema[var].metadata or {}):
        return [str(x) for x in meta["levels"]]
    return None


def add_groups(df: DataFrame, customs: Sequence[CustomGroup], totals: Sequence[TotalGroup]) -> DataFrame:
    """Rows once more under each pooled or total level, by one explode a variable; copies are marked."""
    marked: set[str] = set()

    def expand(df: DataFrame, var: str, extra: list[Column], skip_copies: bool) -> DataFrame:
        flag = SYNTHETIC + var
        if flag not in marked:
            df = df.withColumn(flag, F.lit(False))
            marked.add(flag)
        own = F.struct(F.col(f"`{var}`").cast("string").alias("v"), F.col(f"`{flag}`").alias("s"))
        more = [F.when(~F.col(f"`{flag}`") if skip_copies else F.lit(True), x) for x in extra]
        array = F.filter(F.array(own, *more), lambda x: x.isNotNull())
        return df.withColumn("__g", F.explode(array)).withColumn(var, F.col("__g.v")).withColumn(flag, F.col("__g.s")).drop("__g")

    for group in customs:
        inside = [
            F.when(F.coalesce(F.col(f"`{group.col_var}`").cast("string").isin(list(map(str, found))), F.lit(False)), F.struct(F.lit(name).alias("v"), F.lit(True).alias("s")))
            for name, found in group.groups.items()
        ]
        df = expand(df, group.col_var, inside, False)
    for total in totals:
        df = expand(df, total.col_var, [F.struct(F.lit(total.label).alias("v"), F.lit(True).alias("s"))], True)
    return df


def originals(df: DataFrame) -> DataFrame:
    """Rows that aren't copies."""
    for c in [c for c in df.columns if c.startswith(SYNTHETIC)]:
        df = df.where(~F.col(f"`{c}`"))
    return df


def once(df: DataFrame) -> DataFrame:
    """A frame of a table's size, computed now and kept in the shared folder of ``spark.checkpoint.dir``.

    What is derived from it doesn't read the source again, and a lost executor doesn't repeat it.  On one machine a
    temporary folder serves; on a cluster without the setting the frame stays lazy, and is computed where it is used.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            return df
        root = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        context.setCheckpointDir(f"file://{root}")
    return df.checkpoint(eager=True)


@dataclass
class Context:
    spec: TableSpec
    options: Options
    source: DataFrame
    data: DataFrame
    pop: DataFrame | None
    pop_source: DataFrame | None
    columns: list[str]
    combos: list[tuple[str, ...]] = field(default_factory=lambda: [()])
    header: dict[tuple[str, ...], int] = field(default_factory=dict)
    col_levels: dict[str, list[str]] = field(default_factory=dict)
    #: A column that tells how often a row counts, or None.
    weight: str | None = None

    @property
    def cols(self) -> tuple[str, ...]:
        return self.spec.cols

    def tally(self, test: Column | None = None) -> Column:
        """The number of rows (that pass a test), by weight where there is one."""
        if self.weight is None:
            return F.count(F.lit(1)) if test is None else F.count_if(test)
        times = F.col(f"`{self.weight}`").cast("long")
        return F.coalesce(F.sum(times if test is None else F.when(test, times)), F.lit(0))

    def levels(self, var: str) -> list[str] | None:
        """The declared levels of a variable, in order."""
        if var in self.spec.levels:
            return [str(x) for x in self.spec.levels[var]]
        return metadata_levels(self.source, var)

    def _counts(self, frame: DataFrame, keys: list[Column]) -> DataFrame:
        tally = self.tally() if self.weight in frame.columns else F.count(F.lit(1))
        return frame.groupBy(*keys).agg(tally.alias("count")).limit(MOST_COLUMNS + 1)

    def pin(self) -> None:
        """The one action before the table itself: counts of the column variables' combinations."""
        if not self.cols:
            return
        keys = [F.col(f"`{c}`").cast("string").alias(c) for c in self.cols]
        seen = {tuple(r[:-1]): r[-1] for r in self._counts(self.data, keys).collect()}
        if len(seen) > MOST_COLUMNS:
            raise ValueError(f"{len(seen)} combinations of {', '.join(self.cols)} are too many for columns of a table (at most {MOST_COLUMNS})")
        named: dict[str, list[str]] = {}
        for group in self.spec.custom_groups:
            named.setdefault(group.col_var, []).extend(group.groups)
        for total in self.spec.total_groups:
            named.setdefault(total.col_var, []).append(total.label)
        for k, c in enumerate(self.cols):
            declared = self.levels(c)
            found = sorted({combo[k] for combo in seen if combo[k] is not None})
            if declared is not None:
                extra = [x for x in named.get(c, []) if x not in declared]
                found = [*declared, *extra, *(x for x in found if x not in declared and x not in extra)]
            self.col_levels[c] = found
        self.combos = list(itertools.product(*(self.col_levels[c] for c in self.cols)))
        if self.pop is not None:
            counted = {tuple(r[:-1]): r[-1] for r in self._counts(self.pop, keys).collect()}
            for k, c in enumerate(self.cols):
                lacking = sorted({x[k] for x in seen if x[k] is not None} - {x[k] for x in counted})
                if lacking:
                    warnings.warn(f"Population data has no rows for level(s) of '{c}': {', '.join(lacking)}", stacklevel=3)
            seen = counted
        self.header = {combo: seen.get(combo, 0) for combo in self.combos}

    def labels(self, combos=None, header=None) -> list[str]:
        combos, header = self.combos if combos is None else combos, self.header if header is None else header
        return [" | ".join(c) + (f" (N={header[c]})" if c in header else "") for c in combos]


def report_errors(found: DataFrame, what: str) -> DataFrame:
    """Drop ``__error``; failures of a caller's function give one warning with how many groups and which messages."""
    found = once(found)
    failed = found.where(F.col("__error").isNotNull()).groupBy("__error").count().orderBy(F.desc("count"), "__error").limit(5).collect()
    if failed:
        lines = "; ".join(f"{r['__error']} ({r['count']} group{'s' * (r['count'] > 1)})" for r in failed)
        warnings.warn(f"{what} failed, its cells are blank: {lines}", stacklevel=4)
    return found.drop("__error")


def message(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"


def keyed(df: DataFrame, names: Sequence[str], prefix: str) -> DataFrame:
    """Columns ``prefix1..`` with the variables as strings."""
    return df.withColumns({f"{prefix}{k}": F.col(f"`{v}`").cast("string") for k, v in enumerate(names, 1)})


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """An equi-join in which null matches null; right keys are dropped."""
    if not keys:
        return left.crossJoin(right) if how != "left" else left.join(right, F.lit(True), "left")
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    condition = None
    for k in keys:
        test = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        condition = test if condition is None else condition & test
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])
