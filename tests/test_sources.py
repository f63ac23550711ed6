"""Text, store, regions and sampling: headers, errors, resumed runs, merged blocks, pruning."""

import bz2

import pytest
from pyspark.sql import functions as F

from locusweave import cli
from locusweave.operators import filters, merge, partition, reshape
from locusweave.plans import catalog
from locusweave.sources import sinks, vcf

from .test_engine import GOLDEN, SF, TPED, VCF, text, write


def lines(spark, path):
    """The text of a folder, its parts joined by name."""
    got = spark.read.text(str(path)).select(F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("i"), "value").collect()
    return [" ".join(r.value.split()) for r in sorted(got, key=lambda r: (r.f, r.i))]


def test_vcf_header(spark, tmp_path):
    folder, head = write(tmp_path / "in", GOLDEN), ["##fileformat=VCFv4.2", "#CHROM POS ID REF ALT QUAL FILTER INFO FORMAT 1 2 3"]
    cli.run(spark, ["vcf", "-i", folder, "-o", f"{tmp_path}/v", "-n", "3", "-H"])
    assert lines(spark, tmp_path / "v") == head + VCF
    cli.run(spark, ["vcf", "-i", folder, "-o", f"{tmp_path}/f", "-n", "3", "-H", "-f"])
    assert lines(spark, tmp_path / "f") == head + VCF
    cli.run(spark, ["vcf", "-i", folder, "-o", f"{tmp_path}/b", "-n", "3", "-H", "-b"])
    assert lines(spark, tmp_path / "b" / "chrom_num=1") == head + VCF[:2] and lines(spark, tmp_path / "b" / "chrom_num=23") == [*head, VCF[4]]
    assert sinks.sample_names(2, 2) == ["1.1", "1.2", "2.1", "2.2"]


def test_sample_files(spark, tmp_path):
    folder = write(tmp_path / "in", GOLDEN)
    vcf.check_samples(spark, folder, 3)
    for n, message in ((2, "3.bz2"), (5, "without a file: 4, 5")):
        with pytest.raises(ValueError, match=message):
            vcf.check_samples(spark, folder, n)
    vcf.check_samples(spark, folder, 5, absent=True)
    write(tmp_path / "in", {"other": []})
    with pytest.raises(ValueError, match="other.bz2"):
        cli.run(spark, ["vcf", "-i", folder, "-o", f"{tmp_path}/v", "-n", "3"])
    ends = write(tmp_path / "ends", {f"run0{k}": rows for k, rows in GOLDEN.items()})
    cli.run(spark, ["tped", "-i", ends, "-o", f"{tmp_path}/t", "-n", "3", "-e", "trailing"])
    assert lines(spark, tmp_path / "t") == TPED
    cli.run(spark, ["names", "-i", ends, "-o", f"{tmp_path}/n", "-e", "trailing"])
    assert lines(spark, tmp_path / "n") == ["1 run01.bz2", "2 run02.bz2", "3 run03.bz2"]


def test_blocks_on_disk(spark, tmp_path):
    """TPED results of sample blocks, written with their reference, merge to the result of all samples."""
    write(tmp_path / "a", {1: GOLDEN[1]})
    write(tmp_path / "b", {1: GOLDEN[2], 2: GOLDEN[3]})
    for k, n in (("a", 1), ("b", 2)):
        cli.run(spark, ["tped", "-i", f"{tmp_path}/{k}", "-o", f"{tmp_path}/{k}-t", "-n", str(n), "-R", "-b", "-z", "bzip2"])
    cli.run(spark, ["blocks", "-i", f"{tmp_path}/a-t,{tmp_path}/b-t", "-o", f"{tmp_path}/t"])
    assert lines(spark, tmp_path / "t") == TPED
    (tmp_path / "odd").mkdir()
    (tmp_path / "odd" / "x").write_text("1\trs\t0\t5\tA\tA G T T\nno row\n1\trs\t0\tx\tA\tA G\n1\trs\t0\t6\tA\tA G T\n")
    assert [(r.pos, r.genotypes) for r in vcf.read_tped(spark, f"{tmp_path}/odd").collect()] == [(5, ["A G", "T T"])]


def test_resume_skips_finished_chromosomes(spark, tmp_path):
    folder = write(tmp_path / "in", GOLDEN)
    run = ["tped", "-i", folder, "-o", f"{tmp_path}/t", "-n", "3", "-b", "-u"]
    cli.run(spark, [*run, "-c", "1-2"])
    (tmp_path / "t" / "chrom_num=1" / "mark").write_text("stays\n")
    cli.run(spark, run)
    assert (tmp_path / "t" / "chrom_num=1" / "mark").exists() and sinks.finished(spark, f"{tmp_path}/t") == [1, 2, 10, 23]
    assert sorted(x for x in lines(spark, tmp_path / "t") if x != "stays") == sorted(TPED) and sinks.finished(spark, f"{tmp_path}/none") == []


def test_stacked_samples_have_one_header(spark, tmp_path):
    rows = [(s, c, p, f"chr{c}", "r", "A", "G", "9", "PASS", "I", "GT", "0|1") for s in ("S1", "S2") for c in (1, 2, 3) for p in (5, 6)]
    split = reshape.split_samples(spark.createDataFrame(rows, "sample string, chrom_num int, pos long, chrom string, id string, ref string, alt string, qual string, filter string, info string, format string, gt string"))
    sinks.write_samples(reshape.sample_lines(split), f"{tmp_path}/s")
    got = lines(spark, tmp_path / "s" / "sample=S1")
    assert got[0].endswith("FORMAT S1") and [x.split()[:2] for x in got[1:]] == [[f"chr{c}", str(p)] for c in (1, 2, 3) for p in (5, 6)]
    sinks.write_samples(reshape.sample_lines(split, stacked=False), f"{tmp_path}/u", stacked=False)
    got = lines(spark, tmp_path / "u" / "sample=S2" / "chrom_num=3")
    assert got[0].endswith("FORMAT S2") and [x.split()[:2] for x in got[1:]] == [["chr3", "5"], ["chr3", "6"]]


def test_regions(spark, tmp_path):
    assert filters.merged_regions(["chr2:5-9", "2:8-12", "X", "chrX:7-9", "2:13", "1:4-4"]) == [(1, 4, 4), (2, 5, None), (23, 1, None)]
    for odd in ("chr99", "chr1:x", "1:9-5", "", "1:5-", "GL000:1-2", "٣"):
        with pytest.raises(ValueError, match="not a region"):
            filters.merged_regions([odd])
    folder = write(tmp_path / "in", GOLDEN)
    cli.run(spark, ["tped", "-i", folder, "-o", f"{tmp_path}/r", "-n", "3", "-p", "2"])
    got = spark.read.text(f"{tmp_path}/r").select("region", F.split("value", "\t")[3].alias("pos")).collect()
    assert sorted(map(tuple, got)) == [("chr10:5-", "5"), ("chr1:100-", "100"), ("chr1:100-", "200"), ("chr2:50-", "50"), ("chrX:7-", "7")]


def test_parts_follow_each_other(spark):
    c = catalog.calls(spark, SF)
    parts = partition.in_parts(c, partition.split_points(c, 4)).withColumn("at", F.spark_partition_id()).select("at", "chrom_num", "part", "pos").collect()
    rows = [tuple(r) for r in parts]
    assert rows == sorted(rows) and [r[1:] for r in rows] == sorted(r[1:] for r in rows) and {r[2] for r in rows} == {0, 1, 2, 3}


def test_store_reads_only_what_is_asked(spark, tmp_path):
    """A region of the store prunes folders and pushes the position to the scan: no index over text is needed."""
    sinks.write_store(catalog.calls(spark, SF), f"{tmp_path}/store")
    plan = filters.by_regions(vcf.read_store(spark, f"{tmp_path}/store"), ["chr4:10-300"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(chrom_num" in plan and "GreaterThanOrEqual(pos,10)" in plan and "LessThanOrEqual(pos,300)" in plan


def test_public_names_and_sampling(spark, tmp_path):
    head = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2\n"
    (tmp_path / "w").mkdir()
    import gzip

    for c, at in (("1", 5), ("2", 6), ("MT", 7)):
        with gzip.open(tmp_path / "w" / f"ALL.chr{c}.phase3_x.20130502.genotypes.vcf.gz", "wt") as f:
            f.write(head + f"{c}\t{at}\tr\tA\tG\t9\tPASS\tI\tGT\t0|0\t0|1\n")
    for range_, want in (("2", ["6"]), ("26", ["7"])):
        cli.run(spark, ["split", "-i", f"{tmp_path}/w", "-o", f"{tmp_path}/s{range_}", "-s", "-w", "-c", range_])
        assert [x.split()[1] for x in lines(spark, tmp_path / f"s{range_}")[1:]] == want
    folder = write(tmp_path / "in", GOLDEN)
    cli.run(spark, ["sample", "-i", folder, "-o", f"{tmp_path}/k", "-k", "2"])
    assert lines(spark, tmp_path / "k") == ["1 200"]
    cli.run(spark, ["points", "-i", folder, "-o", f"{tmp_path}/p", "-p", "2", "-s", "1"])
    assert lines(spark, tmp_path / "p") == ["1 1 100", "2 1 50", "10 1 5", "23 1 7"]
    assert partition.bernoulli(catalog.calls(spark, SF), 0.1).count() < 0.2 * catalog.calls(spark, SF).count()
    # A sample that is too small to cut anything falls back to all calls.
    c = catalog.calls(spark, SF)
    assert sorted(partition.split_or_sampled(c, 4, 1e-9).collect()) == sorted(partition.split_points(c, 4).collect())


def test_family_by_chromosome(spark, tmp_path):
    (tmp_path / "info").write_text("p1 s1 x M x Case\n")
    (tmp_path / "names").write_text("p2 p1\n")
    cli.run(spark, ["tfam", "-i", f"{tmp_path}/info", "-d", f"{tmp_path}/names", "-o", f"{tmp_path}/f", "-c", "21-X"])
    assert sinks.finished(spark, f"{tmp_path}/f") == [21, 22, 23] and lines(spark, tmp_path / "f" / "chrom_num=22") == ["0 p2 0 0 0 0", "0 p1 0 0 1 2"]


def test_reference_conflict_flag(spark, tmp_path):
    files = {1: ["1 3 c A T 5 PASS x GT 0/1:9", "1 4 c A T 5 PASS x GT 0/1:9"], 2: ["1 3 c G T 5 PASS y GT 0/1:8", "1 4 c A T 5 PASS y GT 1/1:8"]}
    got = merge.merge_vcf(vcf.read_vcf(spark, write(tmp_path / "in", files)), 2, flag=True).collect()
    assert [(r.pos, r.ref_conflict) for r in got] == [(3, True), (4, False)] and got[0].genotypes == ["0/1:9", "./1:8"]


def test_weather_without_sign(spark, tmp_path):
    record = lambda sign, value, q: "0" * 4 + "123456" + "78901" + "195001010600" + "0" * 60 + sign + value + q
    (tmp_path / "w").write_text("\n".join([record("+", "0011", "1"), record("-", "0011", "1"), record("0", "0011", "1"), record("+", "9999", "1"), record("+", "0012", "7")]))
    assert [(r.station, r.temp) for r in filters.valid_reading(vcf.read_weather(spark, f"{tmp_path}/w")).collect()] == [("123456-78901", 11), ("123456-78901", -11)]


def test_calls_written_by_sample(spark, tmp_path):
    golden = vcf.read_vcf(spark, write(tmp_path / "in", GOLDEN))
    sinks.write_calls(golden, f"{tmp_path}/out")
    again = vcf.read_vcf(spark, f"{tmp_path}/out", numbered="folder")
    assert text(merge.merge_vcf(filters.by_quality(again), 3), sinks.vcf_line()) == VCF
    assert bz2.open(next((tmp_path / "out" / "sample_id=2").glob("part-*.bz2")), "rt").readline().startswith("chr1\t100\trs1")


def test_files_named_by_sample(spark, tmp_path):
    calls = vcf.parse_calls(spark.createDataFrame([(f"chr1\t{p}\tr\tA\tC\t9\tPASS\ti\tGT\t0/1", s) for s in (1, 2, 11) for p in range(1, 40)], "value string, sample_id int"))
    sinks.write_calls(calls, f"file://{tmp_path}/folders")
    n = sinks.name_by_sample(spark, f"file://{tmp_path}/folders", f"file://{tmp_path}/flat")
    names = sorted(x.name for x in (tmp_path / "flat").iterdir() if x.name.endswith("bz2"))
    assert len(names) == n and {x.split(".")[0] for x in names} == {"1", "2", "11"}
    got = vcf.read_vcf(spark, f"file://{tmp_path}/flat")
    assert sorted((r.sample_id, r.pos) for r in got.collect()) == sorted((s, p) for s in (1, 2, 11) for p in range(1, 40))
