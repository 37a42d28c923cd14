"""Per-assay summaries of large result files, all assays in one job.

Inputs are rows with ``assay_id`` and the file's content, as raw ``line`` or as
columns; outputs are one row per assay.  Text is read and parsed once, into a
histogram per assay that is combined map-side and written once; counts, means
and the exact median all come from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohort_ledger.operators.rank import exact_median
from cohort_ledger.session import cut


def _value_histogram(parsed: DataFrame, columns: list[str]) -> DataFrame:
    """Counts per assay and parsed columns; one scan of the text."""
    return cut(parsed.groupBy("assay_id", *columns).agg(F.count(F.lit(1)).alias("count")))


def _median_of(hist: DataFrame, value: str) -> DataFrame:
    counts = (
        hist.filter(F.col(value).isNotNull())
        .groupBy("assay_id", F.col(value).alias("value"))
        .agg(F.sum("count").alias("count"))
    )
    return exact_median(counts, ["assay_id"], "_median")


def _weighted(test: Column) -> Column:
    """Sum of the counts where ``test`` holds."""
    return F.coalesce(F.sum(F.when(test, F.col("count"))), F.lit(0))


def _is_data(line: Column) -> Column:
    return (line != "") & ~line.startswith("#")


def methylation_summary(lines: DataFrame, min_coverage: int = 5) -> DataFrame:
    """Sites, mean, exact median and well-covered share of 5mC calls per assay.

    An assay without any call gets zeros.
    """
    text = F.regexp_replace("line", r"\n+\z", "")
    fields = F.split(text, "\t", -1)
    call = _is_data(text) & (F.size(fields) >= 11) & (F.get(fields, F.lit(3)) == "m")
    share = F.when(call, F.get(fields, F.lit(10)).try_cast("double"))
    coverage = F.coalesce(F.get(fields, F.lit(9)).try_cast("bigint"), F.lit(0))
    parsed = lines.select("assay_id", share.alias("frac"), (coverage >= min_coverage).alias("high"))
    parsed = parsed.withColumn("high", F.col("high") & F.col("frac").isNotNull())
    hist = _value_histogram(parsed, ["frac", "high"])
    sites = F.col("frac").isNotNull()
    sums = hist.groupBy("assay_id").agg(
        _weighted(sites).alias("n_cpg_sites"),
        F.sum(F.col("frac") * F.col("count")).alias("_sum"),
        _weighted(F.col("high")).alias("_high"),
    )
    n = F.nullif(F.col("n_cpg_sites"), F.lit(0))
    zero = F.lit(0.0)
    return sums.join(_median_of(hist, "frac"), "assay_id", "left").select(
        "assay_id",
        "n_cpg_sites",
        F.coalesce(F.round(F.col("_sum") / (n * 100), 4), zero).alias("mean_meth"),
        F.coalesce(F.round(F.col("_median") / 100, 4), zero).alias("median_meth"),
        F.coalesce(F.round(100.0 * F.col("_high") / n, 2), zero).alias("pct_high_conf"),
    )


def methylation_summary_flat(lines: DataFrame) -> DataFrame:
    """The flat-mode variant: any code containing m, NULLs for an assay without calls."""
    text = F.col("line")
    fields = F.split(text, "\t", -1)
    call = _is_data(text) & F.contains(F.lower(F.get(fields, F.lit(3))), F.lit("m"))
    parsed = lines.select(
        "assay_id",
        F.coalesce(call, F.lit(False)).alias("call"),
        F.when(call, F.get(fields, F.lit(10)).try_cast("double")).alias("pct"),
        F.when(call, F.get(fields, F.lit(9)).try_cast("double")).alias("cov"),
    )
    hist = _value_histogram(parsed, ["call", "pct", "cov"])
    sums = hist.groupBy("assay_id").agg(
        _weighted(F.col("call")).alias("_n"),
        F.sum(F.col("pct") * F.col("count")).alias("_pct"),
        _weighted(F.col("pct").isNotNull()).alias("_n_pct"),
        _weighted(F.col("pct") > 50).alias("_above"),
        F.sum(F.col("cov") * F.col("count")).alias("_cov"),
        _weighted(F.col("cov").isNotNull()).alias("_n_cov"),
    )

    def mean(total: str, n: str) -> Column:
        return F.col(total) / F.nullif(F.col(n), F.lit(0))

    return sums.join(_median_of(hist, "pct"), "assay_id", "left").select(
        "assay_id",
        F.col("_n").alias("modkit_total_cpg"),
        F.round(mean("_pct", "_n_pct") / 100, 4).alias("modkit_mean_meth"),
        F.round(F.col("_median") / 100, 4).alias("modkit_median_meth"),
        F.round(mean("_above", "_n"), 4).alias("modkit_meth_above_50pct"),
        F.round(mean("_cov", "_n_cov"), 1).alias("modkit_mean_coverage"),
    )


def sv_summary(lines: DataFrame) -> DataFrame:
    """Structural variants per assay by type, and the median size.

    Types outside the known five count as BND, and duplications are reported
    with them.
    """
    # Variant types.
    known = ("INS", "DEL", "INV", "DUP", "BND")
    info = F.when(_is_data(F.col("line")), F.get(F.split("line", "\t", -1), F.lit(7)))
    given = F.nullif(F.regexp_extract(info, r"(?:^|;)SVTYPE=([^;]+)", 1), F.lit(""))
    size = F.nullif(F.regexp_extract(info, r"(?:^|;)SVLEN=(-?\d+)", 1), F.lit(""))
    parsed = lines.select(
        "assay_id", given.alias("given"), F.abs(size.try_cast("bigint")).alias("size")
    )
    hist = _value_histogram(parsed, ["given", "size"]).withColumn(
        "type",
        F.when(F.col("given").isin(*known), F.col("given")).when(
            F.col("given").isNotNull(), "BND"
        ),
    )
    counts = hist.groupBy("assay_id").agg(
        _weighted(F.col("type").isNotNull()).alias("n_svs_total"),
        *[_weighted(F.col("type") == t).alias(f"n_{t.lower()}") for t in ("INS", "DEL", "INV")],
        _weighted(F.col("type").isin("BND", "DUP")).alias("n_bnd"),
    )
    medians = _median_of(hist.filter(F.col("type").isNotNull()), "size")
    return counts.join(medians, "assay_id", "left").select(
        "assay_id",
        "n_svs_total",
        "n_ins",
        "n_del",
        "n_inv",
        "n_bnd",
        F.coalesce(F.floor("_median"), F.lit(0)).cast("bigint").alias("sv_size_median"),
    )


def _first_count(text: Column, keyword: str) -> Column:
    """Leading integer of the first line that contains ``keyword``."""
    lines = F.filter(F.split(text, r"\r\n|\n|\r"), lambda x: F.contains(x, F.lit(keyword)))
    number = F.regexp_extract(F.get(lines, F.lit(0)), r"\A\s*(\d+)", 1)
    return F.nullif(number, F.lit("")).cast("bigint")


def alignment_summary(reports: DataFrame) -> DataFrame:
    """Counts of alignment reports ``(assay_id, text)``, one report per row.

    A report that lacks a keyword line is marked in ``reject``.
    """
    # Keywords of the report.
    keywords = {
        "total_reads": "in total",
        "mapped_reads": "mapped (",
        "properly_paired_reads": "properly paired",
        "duplicates_reads": "duplicates",
        "supplementary_reads": "supplementary",
    }
    counted = reports.select(
        "assay_id", *[_first_count(F.col("text"), k).alias(c) for c, k in keywords.items()]
    )
    total, mapped = F.col("total_reads"), F.col("mapped_reads")
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in keywords]))
    return counted.select(
        "assay_id",
        "total_reads",
        "mapped_reads",
        F.when(total == 0, 0.0)
        .otherwise(F.round(100.0 * mapped / F.nullif(total, F.lit(0)), 2))
        .alias("mapped_pct"),
        "properly_paired_reads",
        "duplicates_reads",
        "supplementary_reads",
        F.when(F.size(missing) > 0, F.array_join(missing, ", ")).alias("reject"),
    )


def insertion_summary(table: DataFrame) -> DataFrame:
    """Insertions per assay: L1 share, full-length L1 and mean read support."""

    def first(*names: str) -> Column | None:
        normal = {c.strip().lower().replace(" ", "_"): c for c in table.columns}
        return next((F.col(f"`{normal[n]}`") for n in names if n in normal), None)

    # Column names over tool versions, and the full length.
    family = first("family", "subfamily", "te_family")
    length = first("te_len", "insert_len", "te_length")
    support = first("numreads", "supportreads", "num_reads", "support")
    is_l1 = (
        F.coalesce(family.cast("string").rlike("(?i)L1|LINE"), F.lit(False))
        if family is not None
        else F.lit(False)
    )
    long = (
        F.coalesce(length.cast("string").try_cast("double") > 6000, F.lit(False))
        if length is not None
        else F.lit(False)
    )
    reads = support.cast("string").try_cast("double") if support is not None else F.lit(None).cast("double")
    return table.groupBy("assay_id").agg(
        F.count(F.lit(1)).alias("tldr_total_insertions"),
        F.count_if(is_l1).alias("tldr_l1_insertions"),
        F.count_if(is_l1 & long).alias("tldr_full_length"),
        F.round(F.avg(reads), 1).alias("tldr_mean_support"),
    )


def _decimals(value: Column, places: int) -> Column:
    """A number as text with a fixed number of decimals and no grouping."""
    return F.call_function("format_number", value, F.lit("0." + "0" * places))


def _flag_columns(reasons: list[Column], warning: Column) -> list[Column]:
    failed = F.concat_ws("; ", *reasons)
    return [
        F.when(failed != "", "false").otherwise("true").alias("qc_pass"),
        failed.alias("qc_fail_reason"),
        F.when(failed != "", "").otherwise(F.coalesce(warning, F.lit(""))).alias("qc_warn"),
    ]


def threshold_flags(
    stats: DataFrame, min_total_reads: int = 1_000_000, min_mapped_pct: float = 95.0
) -> DataFrame:
    """Alignment stats with pass, reason and warning columns.

    The warning is free text, which never turns into a warning event.
    """
    reads, pct = F.col("total_reads"), F.col("mapped_pct")
    shown = _decimals(pct, 2)
    reasons = [
        F.when(
            reads < min_total_reads,
            F.concat(F.lit("total_reads="), F.format_number(reads, 0), F.lit(f" < {min_total_reads:,} (min)")),
        ),
        F.when(
            pct < min_mapped_pct,
            F.concat(F.lit("mapped_pct="), shown, F.lit(f" < {min_mapped_pct} (min)")),
        ),
    ]
    warning = F.when(
        pct < min_mapped_pct + 3.0,
        F.concat(F.lit("mapped_pct="), shown, F.lit(" within 3pp of fail threshold")),
    )
    return stats.select("*", *_flag_columns(reasons, warning))


def merge_summary(
    inputs: DataFrame,
    merged_reports: DataFrame,
    min_total_reads: int = 1_000_000,
    min_mapped_pct: float = 95.0,
) -> DataFrame:
    """Per specimen: number of merged files, and stats and flags of the merged file.

    ``inputs`` is ``(specimen_id, path)``; ``merged_reports`` is
    ``(specimen_id, text)``.
    """
    counts = (
        inputs.filter(F.trim("path") != "")
        .groupBy("specimen_id")
        .agg(F.count(F.lit(1)).alias("merged_n_input_bams"))
    )
    stats = alignment_summary(
        merged_reports.select(F.col("specimen_id").alias("assay_id"), "text")
    )
    flagged = threshold_flags(stats, min_total_reads, min_mapped_pct)
    return (
        flagged.withColumnRenamed("assay_id", "specimen_id")
        .join(counts, "specimen_id", "left")
        .select(
            "specimen_id",
            F.coalesce("merged_n_input_bams", F.lit(0)).alias("merged_n_input_bams"),
            F.col("total_reads").alias("merged_total_reads"),
            F.col("mapped_reads").alias("merged_mapped_reads"),
            F.col("mapped_pct").alias("merged_mapped_pct"),
            "qc_pass",
            "qc_fail_reason",
            "qc_warn",
        )
    )


def threshold_flags_multi(
    stats: DataFrame,
    min_cells: int = 1000,
    fail_mito: float = 20.0,
    warn_mito: float = 15.0,
) -> DataFrame:
    """Single-cell stats (``n_cells``, ``pct_mito``) with flag columns."""
    cells, mito = F.col("n_cells"), F.col("pct_mito")
    shown = _decimals(mito, 1)
    reasons = [
        F.when(cells < min_cells, F.concat(F.lit("n_cells="), cells.cast("string"), F.lit(f" < {min_cells}"))),
        F.when(
            mito > fail_mito,
            F.concat(F.lit("pct_mito="), shown, F.lit(f"% > {fail_mito:g} (high mitochondrial)")),
        ),
    ]
    warning = F.when(
        mito > warn_mito,
        F.concat(F.lit("pct_mito="), shown, F.lit(f"% within {fail_mito - warn_mito:g}pp of fail threshold")),
    )
    return stats.select("*", *_flag_columns(reasons, warning))
