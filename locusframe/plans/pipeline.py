"""Config-driven filter chains: every step reads the written result of the one before it, with a count and a rescue figure."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.operators import intervals as iv
from locusframe.operators import qc
from locusframe.operators import variants as v
from locusframe.tables import materialise

#: The default chain, the names of its steps and their parameters.
DEFAULT = {
    "steps": [
        {"name": "hard_qc_filter"}, {"name": "singleton_counts", "report": True}, {"name": "singleton_filter_add_ads"}, {"name": "tandem_repeat_mask", "enabled": False}, {"name": "core_region_filter", "enabled": False},
        {"name": "paralog_mask", "enabled": False}, {"name": "filter_ad_regenotype"}, {"name": "biallelic_snp_filter"}, {"name": "sample_coverage_filter"}, {"name": "locus_missingness_filter"}, {"name": "maf_filter", "params": {"maf_min": 0.02}},
    ]
}

#: Steps that a whitelist can overrule.
WHITELISTABLE = {"hard_qc_filter", "singleton_filter_add_ads", "tandem_repeat_mask", "core_region_filter", "paralog_mask", "locus_missingness_filter", "maf_filter"}


def _mask(exclude: bool) -> Callable[..., DataFrame]:
    def run(records: DataFrame, bed: DataFrame | None = None, keep: DataFrame | None = None) -> DataFrame:
        if bed is None:
            raise ValueError("a region step needs its BED frame")
        return iv.region_filter(records, bed, exclude=exclude, keep=keep)

    return run


STEPS: dict[str, Callable[..., DataFrame]] = {
    "hard_qc_filter": v.hard_qc, "singleton_filter_add_ads": v.singleton_filter, "tandem_repeat_mask": _mask(True), "core_region_filter": _mask(False), "paralog_mask": _mask(True),
    "filter_ad_regenotype": v.ad_regenotype, "biallelic_snp_filter": v.biallelic_snps, "strip_stale_format": v.strip_stale, "locus_missingness_filter": v.locus_missingness, "maf_filter": v.maf_filter,
    "sample_coverage_filter": lambda records, **p: v.sample_coverage_filter(records, **p)[0],
}


def _singleton_report(records: DataFrame, **params) -> DataFrame:
    cells = records.select(F.concat_ws(":", "chrom", "pos0").alias("site"), F.posexplode("calls").alias("sample_ix", "c"))
    flat = cells.select("site", "c.sample", "sample_ix", F.coalesce(F.exists("c.gt", lambda a: a > 0), F.lit(False)).alias("alt"), v.g.is_missing(F.col("c.gt")).alias("missing"), F.aggregate("c.ad", F.lit(0).cast("long"), lambda s, d: s + F.coalesce(d, F.lit(0))).alias("depth"))
    return qc.flag_outliers(qc.singleton_counts(flat, params.get("max_missing_frac", 0.2), params.get("min_depth", 5)))


REPORTS: dict[str, Callable[..., DataFrame]] = {"singleton_counts": _singleton_report, "sample_coverage": lambda records, **p: v.sample_coverage(records, **p)}


def load_config(text: str) -> dict:
    return json.loads(text)


def run(records: DataFrame, config: dict | None = None, keep: DataFrame | None = None, beds: dict[str, DataFrame] | None = None, outdir: str | None = None) -> tuple[DataFrame, list[dict], dict[str, DataFrame]]:
    """Result, tally and reports.

    A step takes `keep` (records it must not drop) unless its params hold keep_bed: null; a BED frame comes from
    beds by step name. Unknown steps and parameters for steps that take none are errors before anything runs.
    Every step is run once: its records are written, to outdir/NN.name or the shared folder, and counted there."""
    config = config or DEFAULT
    steps = [s for s in config.get("steps", []) if s.get("enabled", True)]
    if unknown := [s["name"] for s in steps if s["name"] not in STEPS and s["name"] not in REPORTS]:
        raise ValueError(f"unknown steps: {', '.join(unknown)}; known: {', '.join(sorted([*STEPS, *REPORTS]))}")
    spark = records.sparkSession

    def written(rows: DataFrame, number: int, name: str) -> DataFrame:
        if outdir is None:
            return materialise(rows, name)
        rows.write.mode("overwrite").parquet(path := f"{outdir}/{number:02d}.{name}")
        return spark.read.schema(rows.schema).parquet(path)

    rows = written(records, 0, "input")
    tally: list[dict] = [{"step": "input", "kind": "input", "count": rows.count(), "rescued": 0}]
    reports: dict[str, DataFrame] = {}
    for number, step in enumerate(steps, 1):
        name, params = step["name"], dict(step.get("params", {}))
        if name in REPORTS and (step.get("report") or name not in STEPS):
            reports[name] = REPORTS[name](rows, **params)
            continue
        own = params.pop("keep_bed", "inherit")
        if name in WHITELISTABLE and keep is not None and own == "inherit":
            params["keep"] = keep
        if beds and name in beds:
            params["bed"] = beds[name]
        rows = written(STEPS[name](rows, **params), number, name)
        rescued = F.count_if("rescued") if "rescued" in rows.columns else F.lit(0)
        figures = rows.agg(F.count("*").alias("n"), rescued.alias("r")).first()
        tally.append({"step": name, "kind": "filter", "count": figures["n"], "rescued": figures["r"]})
        rows = rows.drop("rescued", "modified")
    return rows, tally, reports
