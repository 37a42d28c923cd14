"""Readers, writers, file summaries, identifier rules and exact medians."""

import random
import statistics

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohort_ledger import sinks, sources, streaming
from cohort_ledger.functions.ids import id_rule, suggest_id
from cohort_ledger.operators import rank, summaries, validate
from cohort_ledger.operators.status import project_summary

REPORT = """2000000 + 0 in total (QC-passed reads + QC-failed reads)
0 + 0 secondary
12345 + 0 supplementary
40000 + 0 duplicates
1950000 + 0 mapped (97.50% : N/A)
0 + 0 paired in sequencing
0 + 0 read1
0 + 0 read2
0 + 0 properly paired (N/A : N/A)
"""


@pytest.mark.parametrize("hot", [False, True])
def test_exact_median_against_brute_force(spark, hot):
    rng = random.Random(7)
    groups = {k: [round(rng.expovariate(0.01), 3) for _ in range(rng.randint(1, 60))] for k in range(20)}
    groups[99] = [float(rng.choice([1, 1, 1, 5, rng.randint(0, 5000)])) for _ in range(4000 if hot else 3)]
    rows = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k int, v double")
    mid = {r.k: r for r in rank.exact_middle(rank.histogram(rows, ["k"], "v"), ["k"]).collect()}
    for k, vs in groups.items():
        ordered = sorted(vs)
        assert (mid[k].n, mid[k].lower, mid[k].upper) == (len(vs), ordered[(len(vs) - 1) // 2], ordered[len(vs) // 2])
    medians = dict(rank.exact_median(rank.histogram(rows, ["k"], "v"), ["k"]).collect())
    assert medians == {k: statistics.median(vs) for k, vs in groups.items()}


def pileup(code, cov, frac):
    return "\t".join(["chr1", "1", "2", code, "0", "+", "1", "2", "0,0,0", str(cov), str(frac)])


def test_methylation(spark):
    lines = [("A1", pileup("m", 10, 80)), ("A1", pileup("m", 2, 20)), ("A1", pileup("m", "x", 50)), ("A1", pileup("h", 9, 1)),
             ("A1", "# comment"), ("A1", "short\tline"), ("A1", pileup("m", 5, "NA")), ("A2", "# nothing")]
    out = {r.assay_id: r for r in summaries.methylation_summary(spark.createDataFrame(lines, "assay_id string, line string")).collect()}
    a = out["A1"]
    assert (a.n_cpg_sites, a.mean_meth, a.median_meth, a.pct_high_conf) == (3, 0.5, 0.5, 33.33)
    assert tuple(out["A2"])[1:] == (0, 0.0, 0.0, 0.0)
    flat = {r.assay_id: r for r in summaries.methylation_summary_flat(spark.createDataFrame(lines, "assay_id string, line string")).collect()}
    assert flat["A1"].modkit_total_cpg == 4 and flat["A2"].modkit_total_cpg == 0 and flat["A2"].modkit_mean_meth is None


def test_sv(spark):
    def call(info):
        return "\t".join(["chr1", "1", "id", "N", "N", ".", "PASS", info])

    lines = [("A1", call("SVTYPE=DEL;SVLEN=-100")), ("A1", call("X=1;SVTYPE=INS;SVLEN=51")), ("A1", call("SVTYPE=TRA")),
             ("A1", call("SVTYPE=DUP;SVLEN=10")), ("A1", call("OTHER=1")), ("A1", "#header"), ("A2", "#header")]
    out = {r.assay_id: tuple(r)[1:] for r in summaries.sv_summary(spark.createDataFrame(lines, "assay_id string, line string")).collect()}
    assert out == {"A1": (4, 1, 1, 0, 2, 51), "A2": (0, 0, 0, 0, 0, 0)}


def test_alignment_and_flags(spark):
    reports = spark.createDataFrame([("A1", REPORT), ("A2", "5 + 0 in total\n")], "assay_id string, text string")
    out = {r.assay_id: r for r in summaries.alignment_summary(reports).collect()}
    assert (out["A1"].total_reads, out["A1"].mapped_pct, out["A1"].reject) == (2000000, 97.5, None)
    assert "mapped_reads" in out["A2"].reject
    stats = spark.createDataFrame(
        [("a", 2_000_000, 97.5), ("b", 900_000, 90.25), ("c", 2_000_000, 99.0)], "assay_id string, total_reads long, mapped_pct double"
    )
    flags = {r.assay_id: r for r in summaries.threshold_flags(stats).collect()}
    assert flags["a"].qc_pass == "true" and flags["a"].qc_warn == "mapped_pct=97.50 within 3pp of fail threshold"
    assert flags["b"].qc_fail_reason == "total_reads=900,000 < 1,000,000 (min); mapped_pct=90.25 < 95.0 (min)"
    assert flags["c"].qc_warn == "" and flags["c"].qc_fail_reason == ""


def test_insertions(spark):
    table = spark.createDataFrame(
        [("A1", "L1HS", "6100", "5"), ("A1", "AluY", "300", "x"), ("A1", "line1", "6000", "8"), ("A1", None, "9000", None)],
        "assay_id string, `Family ` string, `TE len` string, NumReads string",
    )
    assert tuple(summaries.insertion_summary(table).first())[1:] == (4, 2, 1, 6.5)


GOOD = ["A1", "a.b-c_d", "0", "x" * 64]
BAD = {None: "null", "": "blank", " \t": "blank", ".": "reserved_literal", "..": "reserved_literal", " .": "reserved_literal",
       "-a": "default_pattern", ".a": "default_pattern", "_a": "default_pattern", "a b": "default_pattern", "a/b": "default_pattern",
       "a\n": "default_pattern", "é": "default_pattern", "x" * 65: "default_pattern", "a;b": "default_pattern", "a$": "default_pattern"}


def test_id_rules(spark):
    frame = spark.createDataFrame([(v,) for v in GOOD + list(BAD)], "id string")
    rules = {r.id: r.rule for r in frame.select("id", id_rule(F.col("id")).alias("rule")).collect()}
    assert rules == {**{g: None for g in GOOD}, **BAD}
    loose = {r.id: r.rule for r in frame.select("id", id_rule(F.col("id"), allow_unicode=True).alias("rule")).collect()}
    assert loose["é"] is None and loose["x" * 65] == "length" and loose["-a"] == "leading_character" and loose["a\n"] == "forbidden_character"
    custom = {r.id: r.rule for r in frame.select("id", id_rule(F.col("id"), pattern="A\\d").alias("rule")).collect()}
    assert custom["A1"] is None and custom["0"] == "custom_pattern"
    clean = spark.createDataFrame([("a b//c",), ("--x--",), ("###",), ("é",)], "id string").select("id", suggest_id(F.col("id")).alias("s"))
    assert {r.id: r.s for r in clean.collect()} == {"a b//c": "a_b_c", "--x--": "x", "###": None, "é": None}


def test_manifest_union_and_summary(spark, tmp_path, rows):
    for name, text in {
        "alpha/manifest.tsv": "sample_id\tqc_done\ns1\t2024\ns2\t\n",
        "beta/manifest.tsv": "sample_id\tdepth\tmod_done\n7\t1.5\t\n",
        "sandbox/manifest.tsv": "sample_id\nzz\n",
        ".hidden/manifest.tsv": "sample_id\nzz\n",
        "a/b/c/d/manifest.tsv": "sample_id\ntoo deep\n",
        "empty/manifest.tsv": "",
        "alpha/other.tsv": "sample_id\nanother name\n",
    }.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    union = sources.read_manifests_union(spark, str(tmp_path), "manifest.tsv")
    assert rows(union, "project", "sample_id", "qc_done", "depth") == [
        ("alpha", "s1", "2024", None), ("alpha", "s2", None, None), ("beta", "7", None, "1.5")
    ]
    assert rows(project_summary(union), "project", "n_samples", "n_analyses", "completed_cells", "total_cells", "pct") == [
        ("alpha", 2, 1, 1, 2, 50.0), ("beta", 1, 1, 0, 1, 0.0)
    ]


def test_manifest_union_reads_headers_in_tasks(spark, tmp_path):
    for name in ("of two+words 50%", "plain"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "m.tsv").write_text("sample_id\tv\n" + "".join(f"{name}{i}\t{i}\n" for i in range(3)))
    with pytest.raises(FileNotFoundError):
        sources.read_manifests_union(spark, str(tmp_path), "absent*.tsv")
    union = sources.read_manifests_union(spark, str(tmp_path), "*.tsv")
    assert sorted(r.sample_id for r in union.collect()) == sorted(f"{n}{i}" for n in ("of two+words 50%", "plain") for i in range(3))


def test_layout(spark, tmp_path, rows):
    for rel in ("cov/v1/P1/S1/A1/out/x.tsv", "cov/v1/P1/S1/x.tsv", "mystery/v1/P1/S1/A1/x.tsv", "x.tsv", "mrg/v2/P1/S1/x.tsv"):
        path = tmp_path / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("depth\n3\n")
    good, bad = sources.read_results_by_layout(
        spark, str(tmp_path), T.StructType([T.StructField("depth", T.LongType())]),
        {"specimen": "{tool}/{run_tag}/{patient_id}/{specimen_id}", "assay": "{tool}/{run_tag}/{patient_id}/{specimen_id}/{assay_id}"},
        {"cov": {"level": "assay", "column_prefix": "c"}, "mrg": {"level": "specimen"}},
    )
    assert rows(good, "level", "tool", "run_tag", "specimen_id", "assay_id", "column_prefix") == [
        ("assay", "cov", "v1", "S1", "A1", "c"), ("specimen", "mrg", "v2", "S1", None, None)
    ]
    assert sorted(r[0] for r in rows(bad, "reject")) == ["level_disagrees", "no_template_matches", "tool_not_declared"]


def test_columns_are_read_by_name(spark, tmp_path, rows):
    bulk = tmp_path / "bulk.tsv"
    bulk.write_text("entity_id\textra\tlevel\tkind\treason\nA1\tx\tassay\tqc_fail\tbad\n")
    good, bad = sources.read_bulk_qc(spark, str(bulk))
    assert rows(good, "level", "entity_id", "kind", "reason") == [("assay", "A1", "qc_fail", "bad")] and bad.isEmpty()
    links = tmp_path / "links.tsv"
    links.write_text("merged_assay_id\tsource_assay_id\nM\tA1\nM\t\n")
    good, bad = sources.read_bulk_lineage(spark, str(links))
    assert rows(good) == [("A1", "M", None)] and bad.first().reject == "blank: source_assay_id"
    links.write_text("source_assay_id\tnote\nA1\tx\n")
    with pytest.raises(ValueError):
        sources.read_bulk_lineage(spark, str(links))
    batches = tmp_path / "batches.csv"
    batches.write_text("operator,batch_id\nann,b1\n")
    assert rows(sources.read_bulk_lineage(spark, str(batches), "batches", ",")[0]) == [("b1", None, None, "ann", None)]
    table = tmp_path / "table.tsv"
    table.write_text("x\tid\n1.5\t7\nbad\t8\n")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("x", T.DoubleType())])
    assert rows(sources.read_manifest(spark, str(table), schema)) == [(7, 1.5), (8, None)]
    assert rows(sources.read_results(spark, str(table), schema)) == [(7, 1.5), (8, None)]
    assert rows(sources.read_sample_sheet(spark, str(table), ["id", "x"])) == [("7", "1.5"), ("8", "bad")]


def test_small_readers(spark, tmp_path, rows):
    bulk = tmp_path / "bulk.tsv"
    bulk.write_text("level\tentity_id\tkind\treason\nassay\tA1\tqc_fail\tbad\nassay\tA2\tqc_fail\t\n")
    good, bad = sources.read_bulk_qc(spark, str(bulk))
    assert rows(good, "entity_id") == [("A1",)] and rows(bad, "entity_id", "reject") == [("A2", "blank: reason")]
    inputs = tmp_path / "inputs.txt"
    inputs.write_text("Assay_ID\tnote\tRole\nA1\tx\ttumor\nA2\ty\t\n\n#A3\n")
    assert rows(sources.read_artifact_inputs(spark, str(inputs))) == [("#A3", None), ("A1", "tumor"), ("A2", None)]
    inputs.write_text("A1\t/data/a1.bam\n")
    assert rows(sources.read_artifact_inputs(spark, str(inputs))) == [("A1", None)]
    listed = spark.createDataFrame([("x", "A1:tumor, A2,A3:")], "artifact_id string, inputs string")
    assert rows(sources.parse_artifact_inputs(listed, "inputs"), "assay_id", "role") == [("A1", "tumor"), ("A2", None), ("A3", None)]
    samples = tmp_path / "samples.txt"
    samples.write_text("s1\n\n# c\ns2\n")
    meta = spark.createDataFrame([("s1", "liver")], "sample_id string, tissue string")
    assert rows(sources.init_manifest(spark, str(samples), meta, ["note"])) == [("s1", "liver", None), ("s2", None, None)]


def test_writers(spark, tmp_path):
    frame = spark.createDataFrame([(1, ["a", "b"])], "n int, xs array<string>")
    sinks.write_table(frame, str(tmp_path / "t"), "tsv")
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "t")).first().xs == '["a","b"]'
    with pytest.raises(ValueError):
        sinks.write_table(frame, str(tmp_path / "u"), "xlsx")
    rows, more = sinks.collect_capped(spark.range(11), 10)
    assert len(rows) == 10 and more
    assert sinks.collect_capped(spark.range(10), 10)[1] is False


def test_stream_append_keeps_the_first_value(spark, tmp_path, rows):
    landing = tmp_path / "landing"
    landing.mkdir()
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("assay_id", "depth", "qc_pass")])
    for i, text in enumerate(("A1\t5\tfalse\nA2\t\ttrue\n", "A1\t9\ttrue\nA2\t7\ttrue\n")):
        (landing / f"{i}.tsv").write_text("assay_id\tdepth\tqc_pass\n" + text)
        streaming.stream_append(
            spark, str(landing), schema, "assay_id", "cov", str(tmp_path / "out"), str(tmp_path / "ck"), "2024-01-01"
        ).awaitTermination()
    base = spark.createDataFrame([("A1",), ("A2",), ("A3",)], "assay_id string")
    out = streaming.current_rows(base, spark.read.parquet(str(tmp_path / "out" / "results")), "assay_id")
    assert rows(out, "assay_id", "depth") == [("A1", "5"), ("A2", "7"), ("A3", None)]
    assert rows(spark.read.parquet(str(tmp_path / "out" / "events")), "entity_id", "kind") == [("A1", "qc_fail")]


def test_flat_checks(spark, rows):
    flat = spark.createDataFrame(
        [("s1", None, "x"), ("s1", None, None), (None, None, "y")], "sample_id string, nothing string, mod_done string"
    )
    assert rows(validate.flat_keys(flat), "check", "key", "detail") == [("duplicate_key", "s1", "2"), ("null_key", "sample_id", "1")]
    assert rows(validate.flat_empty_columns(flat), "key") == [("nothing",)]
    assert rows(validate.flat_schema(flat, {"mod": ["mod_done", "mod_x"]}), "check", "key") == [("recorded_missing", "mod_x")]
    assert rows(validate.flat_schema(flat, {}), "check", "key") == [("done_without_data", "mod_done")]


def test_a_run_leaves_nothing_behind(spark):
    from pathlib import Path

    from cohort_ledger.session import cut, fresh_path, run_folder

    with run_folder(spark) as folder:
        assert cut(spark.range(5)).count() == 5 and fresh_path(spark, "x").startswith(folder)
        assert Path(folder).exists()
        with run_folder(spark) as inner:
            assert cut(spark.range(2)).count() == 2 and inner.startswith(folder)
        assert not Path(inner).exists()
    assert not Path(folder).exists() and not fresh_path(spark, "x").startswith(folder)


def test_digests_are_read_in_ranges(spark, tmp_path):
    import hashlib

    rng = random.Random(4)
    bodies = {"empty": b"", "one": b"x", "exact": rng.randbytes(64), "long": rng.randbytes(100_003), "two words.gz": b"not packed"}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    paths = [str(tmp_path / n) for n in bodies] + [f"file:{tmp_path}/long", f"file://{tmp_path}/long", f"{tmp_path}/gone", None, f"{tmp_path}/one"]
    logged = spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "results_file string, digest long")
    for options in ({}, {"step": 64}, {"step": 7, "tasks": 3}):
        got = {r.path: (r.digest, r.size) for r in sources.file_digests(logged, "results_file", **options).collect()}
        want = {str(tmp_path / n): (hashlib.md5(b).hexdigest(), len(b)) for n, b in bodies.items()}
        want |= dict.fromkeys(paths[5:7], want[str(tmp_path / "long")]) | dict.fromkeys(paths[7:9], (None, None))
        assert got == want
    [row] = sources.file_digests(logged.limit(1), "results_file", "sha256").collect()
    assert row.digest == hashlib.sha256(b"").hexdigest()
    assert sources.file_digests(logged.limit(0), "results_file").count() == 0
    with pytest.raises(Exception, match="[Dd]irectory|file"):
        sources.file_digests(spark.createDataFrame([(str(tmp_path),)], "path string")).collect()
    log = spark.createDataFrame(
        [(paths[1], hashlib.md5(b"x").hexdigest()), (paths[3], "0" * 32), (paths[7], "1" * 32), (paths[0], None)], "results_file string, results_checksum string"
    )
    found = validate.checksum_match(log, sources.file_digests(log, "results_file")).collect()
    assert {(r.key, r.detail) for r in found} == {(paths[3], "changed"), (paths[7], "missing")}


def test_a_long_file_is_digested_in_flat_memory(tmp_path):
    import hashlib

    import pyarrow as pa

    from cohort_ledger.sources import digests

    path = tmp_path / "sparse"
    size = (2 << 30) + 5  # beyond what one row can hold; a hole, so it takes no disk
    with path.open("wb") as f:
        f.truncate(size)
    want, zeros = hashlib.md5(), bytes(1 << 20)
    for _ in range(size >> 20):
        want.update(zeros)
    want.update(bytes(size & ((1 << 20) - 1)))
    before = pa.default_memory_pool().max_memory()
    assert digests._digest(str(path), "md5", digests.RANGE_BYTES) == (want.hexdigest(), size)
    assert pa.default_memory_pool().max_memory() <= max(before, 4 * digests.RANGE_BYTES)


def test_files_of_rows_are_written_by_many_tasks(spark, tmp_path):
    import hashlib

    rows = spark.range(300).select(F.concat(F.lit("s="), "id", F.lit(".txt")).alias("name"), F.concat(F.lit("line "), "id").alias("content"))
    rows = rows.unionByName(spark.createDataFrame([(None, "x"), ("y", None)], "name string, content string"))
    written = sinks.write_files(rows, f"{tmp_path}/out")
    paths = {r.path: r.content for r in written.collect()}
    assert len(paths) == 300 and written.inputFiles() and len({p.rsplit("/", 2)[1] for p in paths}) > 30
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{tmp_path}/out")
    assert {r.path: bytes(r.content).decode() for r in found.collect()} == paths
    dealt = sources.file_digests(written)
    assert dealt.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {r.path: r.digest for r in dealt.collect()} == {p: hashlib.md5(c.encode()).hexdigest() for p, c in paths.items()}


def test_export_of_a_subset_works_out_each_level_once(spark, capsys):
    """The levels above read the chosen rows of the level below, not the whole chain again."""
    patients = spark.createDataFrame([("P1", "consented", "pass"), ("P2", "consented", "pass")], "patient_id string, consent_status string, qc_status string")
    specimens = spark.createDataFrame([("S1", "P1", "pass"), ("S2", "P2", "pass")], "specimen_id string, patient_id string, qc_status string")
    assays = spark.createDataFrame([("A1", "S1", "pass", "x"), ("A2", "S2", "pass", "y")], "assay_id string, specimen_id string, qc_status string, of_assays string")
    subset = assays.filter("of_assays = 'x'").select("assay_id")
    frames = sinks.export_plan(patients, specimens, assays, subset=subset)
    assert {n: [r[0] for r in f.collect()] for n, f in frames.items()} == {"patients": ["P1"], "specimens": ["S1"], "assays": ["A1"]}
    frames["patients"].explain(extended=True)
    assert "of_assays" not in capsys.readouterr().out


def test_export_works_out_the_cascade_once(spark, monkeypatch):
    """Artifacts are marked by the assays that are exported, unless those are more than the usable ones."""
    from cohort_ledger.operators import artifacts as art

    patients = spark.createDataFrame([("P1", "pass", "consented"), ("P2", "pass", "revoked")], "patient_id string, qc_status string, consent_status string")
    specimens = spark.createDataFrame([("S1", "P1", "pass"), ("S2", "P2", "pass")], "specimen_id string, patient_id string, qc_status string")
    assays = spark.createDataFrame([("A1", "S1", "pass"), ("A2", "S2", "pass"), ("A3", "S1", "fail"), (None, "S1", "pass")], "assay_id string, specimen_id string, qc_status string")
    artifacts = spark.createDataFrame([("1",), ("2",), ("3",)], "artifact_id string")
    inputs = spark.createDataFrame([("1", "A1"), ("1", "A2"), ("2", "A1"), ("2", None), ("1", "A3"), ("9", "A1")], "artifact_id string, assay_id string")
    sides = {"cohort_artifacts": artifacts, "cohort_artifact_inputs": inputs}
    lenient = sinks.export_plan(patients, specimens, assays, True, True, **sides)
    assert lenient["assays"].count() == 4

    def refused(*_, **__):
        raise AssertionError("the cascade is worked out again")

    monkeypatch.setattr(art, "active_assays", refused)
    frames = sinks.export_plan(patients, specimens, assays, **sides)
    for plan in (lenient, frames):
        assert sorted(map(tuple, plan["cohort_artifacts"].collect())) == [("1", 2, True), ("2", 1, True), ("3", 0, False)]
    assert {r.assay_id for r in frames["assays"].collect()} == {"A1", None}


def test_merged_sources_take_one_exchange(spark, tmp_path, capsys):
    """The first assay of the line before, as by joining lines with the first of each."""
    from cohort_ledger.plans.dataset import Model

    model = Model(spark, str(tmp_path))
    rows = [(f"{s}-{line}-{n}-0", str(s)) for s in range(6) for line in (1, 2, 3, 5)[: s + 1] for n in (7, 3)[: 1 + s % 2]]
    model.assay_rows = spark.createDataFrame([*rows, ("9-2-1-0", None)], "assay_id string, specimen_id string")
    got = {(r.source_assay_id, r.merged_assay_id) for r in model.assay_sources.filter("merged_assay_id IS NOT NULL").collect()}
    line = lambda a: int(a.split("-")[1])
    first = {}
    for a, s in rows:
        first[s, line(a)] = min(a, first.get((s, line(a)), a))
    assert got == {(a, first[s, line(a) - 1]) for a, s in rows if (s, line(a) - 1) in first}
    model.assay_sources.explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 1
