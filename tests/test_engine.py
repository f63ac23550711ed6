"""The variant engine: golden rows, edge cases, properties, and equality with DuckDB."""

import bz2
import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from locusweave.functions import variant as V
from locusweave.operators import filters, merge, partition, reshape
from locusweave.plans import catalog
from locusweave.sources import sinks, vcf
from locusweave.streaming import incremental

SF = "/root/testdata/sf0.001"
GOLDEN = {
    1: ["chr1 100 rs1 A G 50 PASS DP=10 GT:DP 0/1:10", "chr1 200 rs2 C T 40 PASS DP=12 GT:DP 1|1:12", "chr2 50 rs3 G A 30 q10 DP=3 GT:DP 0/1:3", "chrX 7 rs4 T C,A 60 PASS DP=9 GT:DP 1/2:9"],
    2: ["chr1 100 rs1 A T 31 PASS DP=11 GT:DP 0/1:11", "chr10 5 rs5 G C 20 PASS DP=8 GT:DP 0/1:8", "chrX 7 rs4 T A 61 PASS DP=7 GT:DP 0/1:7"],
    3: ["chr2 50 rs3 G A 35 PASS DP=4 GT:DP 1/1:4", "chr2 60 rs6 C G 33 q20 DP=5 GT:DP 0/1:5", "chr10 5 rs5 G C 25 PASS DP=6 GT:DP 1/1:6"],
}
TPED = ["1 rs1 0 100 A G A T A A", "1 rs2 0 200 T T C C C C", "2 rs3 0 50 G G G G A A", "10 rs5 0 5 G G G C C C", "23 rs4 0 7 C A T A T T"]
VCF = [
    "chr1 100 rs1 A G,T 40.5 PASS DP=10;DP=11 GT:DP 0/1:10 0/2:11 .", "chr1 200 rs2 C T 40.0 PASS DP=12 GT:DP 1/1:12 . .", "chr2 50 rs3 G A 35.0 PASS DP=4 GT:DP . . 1/1:4",
    "chr10 5 rs5 G C 22.5 PASS DP=8;DP=6 GT:DP . 0/1:8 1/1:6", "chrX 7 rs4 T A,C 60.5 PASS DP=9;DP=7 GT:DP 2/1:9 0/1:7 .",
]


def write(folder, files):
    os.makedirs(folder, exist_ok=True)
    for k, rows in files.items():
        with bz2.open(f"{folder}/{k}.bz2", "wt") as f:
            f.write("\n".join(["##fileformat=VCFv4.1", "#CHROM POS"] + [r.replace(" ", "\t") for r in rows]) + "\n")
    return str(folder)


@pytest.fixture(scope="module")
def golden(tmp_path_factory, spark):
    return vcf.read_vcf(spark, write(tmp_path_factory.mktemp("golden") / "in", GOLDEN))


def text(df, line):
    return [" ".join(r[0].split()) for r in df.select(line).collect()]


def test_golden(golden):
    kept = filters.by_quality(golden, "PASS")
    assert text(merge.merge_tped(kept, 3), sinks.tped_line()) == TPED
    assert text(merge.merge_vcf(kept, 3), sinks.vcf_line()) == VCF
    assert "2 rs6 0 60 C C C C C G" in text(merge.merge_tped(filters.by_quality(golden, "q20"), 3), sinks.tped_line())
    assert "2 rs3 0 50 G A G G A A" in text(merge.merge_tped(filters.by_quality(golden, "q10"), 3), sinks.tped_line())


def case(spark, files, tmp_path, columns=(9,)):
    return vcf.read_vcf(spark, write(tmp_path / "in", files), columns)


def test_edges(spark, tmp_path):
    files = {
        1: ["CHR1 1 a A G . PASS x GT:DP ./.:3", "1 2 b A C,G,T,AA,CC,GG,TT,AC,AG,ATT 5 PASS x GT 10/2:1", "1 3 c A T 5 PASS x GT 0/1:9", "MT 4 d A G 5 PASS x GT 1", "GL000 5 e A G 5 PASS x GT 0/1", "1 6 f A G 5 q10 PASS GT 0/1"],
        2: ["1 3 c G T 5 PASS y GT 0/1:8", "1 3 c G T 7 PASS z GT 1/1:8"],
        3: [],
    }
    kept = filters.by_quality(case(spark, files, tmp_path), "PASS")
    got = {(r.chrom_num, r.pos): r for r in merge.merge_vcf(kept, 3).collect()}
    assert sorted(got) == [(1, 1), (1, 2), (1, 3), (26, 4)]
    assert got[1, 1].genotypes == [".", ".", "."] and got[1, 1].qual is None
    assert got[1, 2].genotypes[0] == "4/7:1" and got[1, 3].genotypes[:2] == ["0/1:9", "1/1:8"] and got[1, 3].qual == 6.0
    assert got[26, 4].genotypes[0] == "1"
    pairs = {(r.chrom_num, r.pos): r.genotypes for r in merge.merge_tped(kept, 3).collect()}
    assert pairs[1, 1] == ["A A"] * 3 and pairs[1, 2][0] == "ATT G" and pairs[26, 4][0] == "G G"


def test_two_genotype_columns(spark, tmp_path):
    files = {1: ["1 1 a A G 50 PASS x GT 0/1:1 1/1:2"], 2: ["1 1 a A C 41 PASS y GT 0/1:3 0|0:4"]}
    r = merge.merge_vcf(case(spark, files, tmp_path, (9, 10)), 3, 2).first()
    assert r.alts == ["C", "G"] and r.qual == 45.5 and r.genotypes == ["0/2:1", "2/2:2", "0/1:3", "0/0:4", ".", "."]


def test_empty(spark, golden):
    none = golden.where("false")
    assert merge.merge_vcf(none, 3).count() == merge.merge_tped(none, 3).count() == 0


def test_order_and_partitions_do_not_matter(spark):
    c = catalog.calls(spark, SF)
    a = [tuple(r) for r in merge.merge_vcf(c, 7).collect()]
    b = [tuple(r) for r in merge.merge_vcf(c.repartition(13, "id").orderBy(F.rand(3)), 7).collect()]
    assert a == b and [x[1:3] for x in a] == sorted(x[1:3] for x in a) and len({x[1:3] for x in a}) == len(a)


@pytest.mark.parametrize("name", ["vcf_merge", "tped_merge"])
def test_merge_uses_one_exchange(spark, name):
    """Duplicates, grouping and order share one physical exchange; the rows are not kept apart by a Python worker."""
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert plan.count("Exchange rangepartitioning") == 1 and plan.count("Exchange ") == 1 and "Python" not in plan and "Arrow" not in plan


def test_reference_correction_and_splits(spark, golden):
    rows = {(r.sample_id, r.pos): r for r in reshape.correct_reference(golden, 1.15, 5).collect()}
    assert (1, 119) in rows and (1, 120) not in rows  # 100 * 1.15 is cut to 114
    assert rows[1, 119].id == "."
    got = [tuple(r) for r in partition.genome_splits(spark, 2, 1, 1).orderBy("split").collect()]
    assert got == [(0, 1, 1, 1, 124478211), (1, 1, 124478212, 1, 248956422)]
    assert [r.region for r in partition.split_regions(partition.genome_splits(spark, 2, 1, 1)).orderBy("split").collect()] == ["chr1:1-124478211", "chr1:124478212-248956422"]


def test_regions_alike_inline_and_joined(spark, golden, monkeypatch):
    want = filters.by_regions(golden, ["chr1:150-300", "X", "2:55"]).count()
    monkeypatch.setattr(filters, "REGIONS_INLINE", 0)
    assert filters.by_regions(golden, ["chr1:150-300", "X", "2:55"]).count() == want == 4


def test_wide_split_and_family(spark, tmp_path):
    (tmp_path / "w").mkdir()
    head = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2\tS3"
    body = "1\t5\tr\tA\tG\t9\tPASS\tI\tGT\t0|0\t0|1\t1|1\n1\t6\tq\tAC\tG\t9\tPASS\tI\tGT\t0|1\t0|1\t1|1"
    (tmp_path / "w" / "a.vcf").write_text(f"##x\n{head}\n{body}\n")
    split = reshape.split_samples(vcf.read_wide(spark, str(tmp_path / "w"), names=["S1", "S3"]))
    assert [(r["sample"], r.pos, r.gt, r.info) for r in split.collect()] == [("S3", 5, "1|1", "N/A")]
    sinks.write_samples(reshape.sample_lines(split), str(tmp_path / "out"))
    assert [r.value.split("\t")[-1] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["S3", "1|1"]
    (tmp_path / "info").write_text("p1 s1 x M x Case\np2 s2 x F x Control\n")
    (tmp_path / "names").write_text("p2 p9\np1\n")
    people, ids = vcf.read_family(spark, str(tmp_path / "info"), str(tmp_path / "names"))
    assert [r.line for r in reshape.family(ids, people).collect()] == ["0 p2 0 0 2 1", "0 p9 0 0 0 0", "0 p1 0 0 1 2"]


def test_stream_equals_batch(spark, tmp_path, golden):
    folder, store = str(tmp_path / "in"), str(tmp_path / "store")
    for some in ({1: GOLDEN[1]}, {2: GOLDEN[2], 3: GOLDEN[3]}):
        write(folder, some)
        incremental.follow(spark, folder, store, str(tmp_path / "state")).awaitTermination()
    got = merge.merge_vcf(filters.by_quality(incremental.current(vcf.read_store(spark, store)), "PASS"), 3)
    assert text(got, sinks.vcf_line()) == VCF


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for p in glob.glob(SF + "/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.execute("select " + ", ".join(f'"{c}"' for c in columns) + f" from ({catalog.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, want))
