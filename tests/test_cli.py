"""The command line gives the golden rows."""

import argparse

import pytest

from locusweave import cli
from locusweave.operators import delta
from locusweave.sources import sinks

from .test_engine import GOLDEN, TPED, VCF, write


def lines(spark, path):
    return [" ".join(r.value.split()) for r in spark.read.text(str(path)).collect()]


def test_merge_load_export(spark, tmp_path):
    folder = write(tmp_path / "in", GOLDEN)
    cli.run(spark, ["tped", "-i", folder, "-o", f"{tmp_path}/t", "-n", "3", "-f"])
    assert lines(spark, tmp_path / "t") == TPED
    cli.run(spark, ["vcf", "-i", folder, "-o", f"{tmp_path}/v", "-n", "3", "-c", "1-2", "-f"])
    assert lines(spark, tmp_path / "v") == VCF[:3]
    cli.run(spark, ["vcf", "-i", folder, "-o", f"{tmp_path}/r", "-n", "3", "-r", "chrX,1:150-300", "-b"])
    assert sorted(lines(spark, tmp_path / "r" / "chrom_num=1") + lines(spark, tmp_path / "r" / "chrom_num=23")) == [VCF[1], VCF[4]]
    cli.run(spark, ["load", "-i", folder, "-o", f"{tmp_path}/store", "-k", f"{tmp_path}/state"])
    cli.run(spark, ["export", "-i", f"{tmp_path}/store", "-o", f"{tmp_path}/e", "-n", "3", "-f"])
    assert lines(spark, tmp_path / "e") == VCF


def test_other_commands(spark, tmp_path):
    folder = write(tmp_path / "in", GOLDEN)
    cli.run(spark, ["correct", "-i", folder, "-o", f"{tmp_path}/c", "-n", "3", "-x", "2", "-y", "1"])
    got = lines(spark, tmp_path / "c")
    assert len(got) == sum(map(len, GOLDEN.values())) and "chr1 201 . A T 31.0 PASS DP=11 GT:DP 0/1:11" in got
    cli.run(spark, ["regions", "-o", f"{tmp_path}/p", "-c", "1", "-p", "2"])
    assert sorted(lines(spark, tmp_path / "p")) == ["chr1:1-124478211", "chr1:124478212-248956422"]
    (tmp_path / "info").write_text("p1 s1 x M x Case\n")
    (tmp_path / "names").write_text("p2 p1\n")
    cli.run(spark, ["tfam", "-i", f"{tmp_path}/info", "-d", f"{tmp_path}/names", "-o", f"{tmp_path}/f"])
    assert sorted(lines(spark, tmp_path / "f")) == ["0 p1 0 0 1 2", "0 p2 0 0 0 0"]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.vcf").write_text("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2\n1\t5\tr\tA\tG\t9\tPASS\tI\tGT\t0|0\t0|1\n")
    cli.run(spark, ["split", "-i", f"{tmp_path}/w", "-o", f"{tmp_path}/s", "-s"])
    assert [x.split()[-1] for x in lines(spark, tmp_path / "s")] == ["S2", "0|1"]


def test_update_index_fetch_compact(spark, tmp_path):
    folder = write(tmp_path / "in", GOLDEN)
    one = write(tmp_path / "first", {k: GOLDEN[k] for k in (1, 2)})
    two = write(tmp_path / "then", {3: GOLDEN[3]})
    for i, batch in enumerate((one, two)):
        cli.run(spark, ["update", "-i", batch, "-s", f"file://{tmp_path}/bins", "-o", f"file://{tmp_path}/merged", "-n", "3", "-k", str(i)])
    cli.run(spark, ["tped", "-i", folder, "-o", f"{tmp_path}/t", "-n", "3", "-f"])
    got = delta.read_merged(spark, f"file://{tmp_path}/merged")
    assert [" ".join(r[0].split()) for r in got.select(sinks.tped_line()).collect()] == lines(spark, tmp_path / "t")
    cli.run(spark, ["index", "-i", folder, "-o", f"file://{tmp_path}/z"])
    cli.run(spark, ["fetch", "-i", f"file://{tmp_path}/z", "-o", f"{tmp_path}/x", "-r", "chrX,1:150-300", "-f"])
    assert sorted(lines(spark, tmp_path / "x")) == sorted(r for rows in GOLDEN.values() for r in rows if r.startswith(("chrX", "chr1 200")))
    cli.run(spark, ["load", "-i", folder, "-o", f"{tmp_path}/store", "-k", f"{tmp_path}/state", "-j", f"{tmp_path}/rejects"])
    cli.run(spark, ["compact", "-i", f"{tmp_path}/store"])
    cli.run(spark, ["export", "-i", f"{tmp_path}/store", "-o", f"{tmp_path}/e", "-n", "3", "-b", "-H"])
    assert len([x for x in lines(spark, tmp_path / "e") if x.startswith("#CHROM")]) == 4 and sorted(x for x in lines(spark, tmp_path / "e") if x[0] != "#") == sorted(VCF)
    cli.run(spark, ["points", "-i", folder, "-o", f"{tmp_path}/p", "-p", "2", "-d"])
    assert "1 1 100" in lines(spark, tmp_path / "p")


def test_chromosomes():
    assert cli.chromosomes("chr1-X") == (1, 23) and cli.chromosomes("MT") == (26, 26)
    with pytest.raises(argparse.ArgumentTypeError):
        cli.chromosomes("5-2")
