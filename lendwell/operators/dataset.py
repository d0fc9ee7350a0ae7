"""The curated dataset with its metadata, built in one pass over the register.

The register is landed once, with a flag for eligible rows and for broken
numbers; the flags are counted where they were landed, the sample is drawn from
the eligible rows, and classes and missing values are counted in the written
sample. Counting by `Observation` would leave the session unable to travel
inside a fitted model's training summary, so that scoring fails.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendwell import fixed_values as fv
from lendwell.functions.cleaning import is_bad_number, target_of
from lendwell.operators.population import (
    REGISTER_NUMBERS,
    is_eligible,
    normalize,
    uniform_sample,
)
from lendwell.session import scratch_path
from lendwell.sources.corpus import scan_files
from lendwell.sources.register import write_curated

ROLES = {
    **dict.fromkeys(fv.PREDICTORS, "predictor"),
    **dict.fromkeys(fv.AUDIT_ONLY, "audit_only"),
    fv.TARGET: "target",
}


@dataclass(frozen=True)
class Dataset:
    """A written dataset: what the register and the sample held."""

    path: str
    size_bytes: int
    requested_rows: int
    seed: int
    population: dict[str, int]
    profile: dict[str, int]

    @property
    def rows(self) -> int:
        return self.profile["rows"]


def with_roles(df: DataFrame) -> DataFrame:
    """Curated columns, each with its role as field metadata, which files keep."""
    return df.select(*(F.col(c).alias(c, metadata={"role": ROLES[c]}) for c in fv.CURATED_COLUMNS))


def column_roles(df: DataFrame) -> dict[str, list[str]]:
    """Columns by role, read from the fields' metadata."""
    roles: dict[str, list[str]] = {}
    for field in df.schema.fields:
        if "role" in field.metadata:
            roles.setdefault(field.metadata["role"], []).append(field.name)
    return roles


ELIGIBLE = "_eligible"


def land_population(register: DataFrame, key: str, path: str) -> dict[str, int]:
    """Write the register's rows normalised, `ELIGIBLE` marking those that are; count them where they lie.

    Other rows carry their flags only. Raises where a numeric column of the
    register holds text.
    """
    ok, bad = F.coalesce(is_eligible(), F.lit(False)), {c: f"_bad_{c}" for c in REGISTER_NUMBERS}
    flags = {ELIGIBLE: ok, **{name: is_bad_number(c) for c, name in bad.items()}}
    rows = normalize(register.withColumns(flags), (key, *flags))
    rows = rows.select(*flags, *(F.when(F.col(ELIGIBLE), F.col(c)).alias(c) for c in rows.columns if c not in flags))
    rows.write.parquet(path)
    target = F.col(fv.TARGET)
    landed = register.sparkSession.read.parquet(path)
    found = landed.agg(
        F.count(F.lit(1)).alias("source_rows"),
        F.count_if(ELIGIBLE).alias("eligible_rows"),
        F.count_if(F.col(ELIGIBLE) & (target == 0)).alias("eligible_denied"),
        F.count_if(F.col(ELIGIBLE) & (target == 1)).alias("eligible_approved"),
        *(F.count_if(name).alias(name) for name in bad.values()),
    ).first().asDict()
    broken = {c: found.pop(name) for c, name in bad.items()}
    if any(broken.values()):
        raise ValueError(f"values that are no numbers: { {c: n for c, n in broken.items() if n} }")
    return found


def build_dataset(
    register: DataFrame,
    path: str,
    key: str = "lar_id",
    n: int = fv.SAMPLE_SIZE,
    seed: int = fv.SAMPLE_SEED,
    limit_bytes: int | None = fv.CSV_SIZE_LIMIT,
) -> Dataset:
    """Write a uniform sample of `n` eligible applications, or all where there are fewer."""
    spark = register.sparkSession
    landed = scratch_path(spark, "eligible")
    population = land_population(register, key, landed)
    rows = min(n, population["eligible_rows"])
    if not rows:
        raise ValueError("no eligible application")
    target = F.col(fv.TARGET)
    eligible = spark.read.parquet(landed).where(ELIGIBLE).select(key, *fv.CURATED_COLUMNS)
    size = write_curated(with_roles(uniform_sample(eligible, key, rows, seed)), path, limit_bytes=limit_bytes)
    profile = spark.read.parquet(path).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(target.isNull()).alias("rows null"),
        *(F.count_if(target == t).alias(f"rows {t}") for t in (0, 1)),
        *(F.count_if(F.col(c).isNull()).alias(f"missing {c}") for c in fv.CURATED_COLUMNS),
        *(
            F.count_if(F.col(c).isNull() & (target == t)).alias(f"missing {c} {t}")
            for c in fv.CURATED_COLUMNS for t in (0, 1)
        ),
    ).first().asDict()
    if profile["rows"] != rows or profile["rows null"]:
        raise ValueError(f"{profile['rows']} rows of {rows}, {profile['rows null']} without a target")
    if not (profile["rows 0"] and profile["rows 1"]):
        raise ValueError(f"{fv.TARGET} must hold both classes")
    return Dataset(path, size, n, seed, population, profile)


def checksum(spark: SparkSession, path: str, pattern: str = "*.parquet") -> str | None:
    """SHA-256 over the sorted digests of a dataset's files; null without files."""
    digests = scan_files(spark, path, pattern).agg(F.sort_array(F.collect_list("sha256")).alias("all"))
    return digests.select(F.when(F.size("all") > 0, F.sha2(F.array_join("all", ""), 256))).first()[0]


def missing_by_target(spark: SparkSession, built: Dataset, columns=fv.PREDICTORS) -> DataFrame:
    """(target, n, proportion, column_name, missing_share) from the counts of the write."""
    p = built.profile
    rows = [(t, p[f"rows {t}"], p["rows"], c, p[f"missing {c} {t}"]) for t in (0, 1) for c in columns]
    table = spark.createDataFrame(rows, "target int, n long, total long, column_name string, missing long")
    return table.select(
        "target", "n", F.round(F.col("n") / F.col("total"), 6).alias("proportion"), "column_name",
        F.round(F.col("missing") / F.col("n"), 6).alias("missing_share"),
    )


def metadata_frame(spark: SparkSession, built: Dataset) -> DataFrame:
    """The dataset's description as rows (section, name, value, text)."""
    p, columns = built.profile, fv.CURATED_COLUMNS
    rows: list[tuple] = [("population", k, n, 1, None) for k, n in built.population.items()]
    rows += [
        ("sampling", "requested_rows", built.requested_rows, 1, None),
        ("sampling", "random_state", built.seed, 1, None),
        ("shape", "rows", p["rows"], 1, None),
        ("shape", "columns", len(columns), 1, None),
    ]
    for t in (0, 1):
        rows.append(("target_count", str(t), p[f"rows {t}"], 1, None))
        rows.append(("target_proportion", str(t), p[f"rows {t}"], p["rows"], None))
        rows += [(f"missingness_{t}", c, p[f"missing {c} {t}"], p[f"rows {t}"], None) for c in columns]
    rows += [("missingness", c, p[f"missing {c}"], p["rows"], None) for c in columns]
    roles = column_roles(spark.read.parquet(built.path))
    rows += [("role", c, None, 1, role) for role, names in roles.items() for c in names]
    table = spark.createDataFrame(rows, "section string, name string, part long, whole long, text string")
    return table.select("section", "name", F.round(F.col("part") / F.col("whole"), 6).alias("value"), "text")
