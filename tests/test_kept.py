"""Kept and indexed results: order after spills, block-gzipped regions, merges by bin and by bucket, rejected lines, sketches."""

import bz2
import gzip
import io
import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from locusweave.operators import delta, merge, partition
from locusweave.plans import catalog
from locusweave.sources import bgzf, sinks, vcf
from locusweave.streaming import incremental

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"

SPILLS = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession, Window, functions as F
from locusweave.plans import catalog
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "3").config("spark.ui.enabled", "false")
         .config("spark.shuffle.spill.numElementsForceSpillThreshold", "1000").config("spark.driver.memory", "3g").getOrCreate())
for name, folder in (("vcf_lines", "chrom_num"), ("region_lines", "region")):
    got = catalog.QUERIES[name](spark, "/root/testdata/sf0.01")
    after = Window.partitionBy(folder).orderBy("line")
    bad = got.withColumn("before", F.lag("pos").over(after)).where("before >= pos").count()
    print("ORDER", name, got.count(), bad)
"""


def test_folders_are_in_order_after_spills():
    env = os.environ | {"PYTHONPATH": ROOT}
    got = subprocess.run([sys.executable, "-c", SPILLS.format(root=ROOT)], env=env, capture_output=True, text=True, timeout=600)
    lines = [x.split() for x in got.stdout.splitlines() if x.startswith("ORDER")]
    assert [(x[1], x[3]) for x in lines] == [("vcf_lines", "0"), ("region_lines", "0")] and all(int(x[2]) > 5_000 for x in lines), got.stderr[-2000:]


def sites(n=4000):
    rng = random.Random(3)
    rows = sorted({(rng.choice([1, 4, 23]), rng.choice([rng.randrange(1, 2_000_000), rng.randrange(1, 240_000_000)])) for _ in range(n)})
    return [(f"chr{'X' if c == 23 else c}", c, p, f"chr{'X' if c == 23 else c}\t{p}\t" + "x" * rng.randrange(400)) for c, p in rows]


def written(rows, length=1):
    index, out = bgzf.Index(), io.BytesIO()
    w = bgzf.Writer(out)
    w.line(b"##head")
    for name, _, pos, line in rows:
        index.add(name, pos, length, *w.line(line.encode()))
    w.close()
    return out.getvalue(), bgzf.Index.unpack(index.pack())


@pytest.mark.parametrize("c,start,end", [(1, 1, 300_000_000), (4, 1_000_000, 1_100_000), (23, 5, 5), (4, 100_000_000, 130_000_000), (1, 299_000_000, 299_000_001)])
def test_index_names_the_blocks(tmp_path, c, start, end):
    rows = sites()
    data, index = written(rows)
    assert gzip.decompress(data) == b"##head\n" + b"".join(r[3].encode() + b"\n" for r in rows)
    (tmp_path / "a.vcf.gz").write_bytes(data)
    (tmp_path / "a.vcf.gz.tbi").write_bytes(gzip.compress(pack_of(rows)))
    read = []
    got = [x.decode() for x in bgzf.lines_of(bgzf.Span(str(tmp_path / "a.vcf.gz"), c, start, end), read.append)]
    assert got == [line for _, n, p, line in rows if n == c and start <= p <= end]
    # Bytes go with the region: besides what it holds, a block at either end of each range.
    assert sum(read) <= sum(map(len, got)) + 3 * bgzf.BLOCK_TEXT and (end - start > 10**8 or sum(read) < len(data) / 3)


def pack_of(rows):
    index, w = bgzf.Index(), bgzf.Writer(io.BytesIO())
    w.line(b"##head")
    for name, _, pos, line in rows:
        index.add(name, pos, 1, *w.line(line.encode()))
    return index.pack()


def test_bins_hold_what_they_should():
    rng = random.Random(1)
    for _ in range(2000):
        a = rng.randrange(1 << 29)
        z = min(1 << 29, a + rng.choice([1, 10, 20_000, 3_000_000]))
        assert bgzf.bin_at(a, z) in bgzf.bins_over(a, z) and bgzf.bin_at(a, z) in bgzf.bins_over(z - 1, z)
    assert bgzf.bin_at(0, 1) == 4681 and bgzf.bin_at(0, 1 << 29) == 0  # as the public format has it


def test_bgzf_source(spark, tmp_path):
    rows = sites(900)
    df = spark.createDataFrame([(a, b, c, d) for a, b, c, d in rows], "chrom string, chrom_num int, pos long, line string").repartition(3)
    path = f"file://{tmp_path}/out"
    bgzf.write_bgzf(df, F.col("line"), path, header=["##fileformat=VCFv4.2", "#CHROM"])
    everything = sorted(r["value"] for r in bgzf.read_bgzf(spark, path).collect())
    assert everything == sorted(d for *_, d in rows)
    assert sorted(x for x in (r["value"] for r in spark.read.option("pathGlobFilter", "*.gz").text(path).collect()) if not x.startswith("#")) == everything  # plain gzip readers
    some = sorted(r["value"] for r in bgzf.read_bgzf(spark, path, ["4:100-1000000", "chrX:1500000", "4:900000-2000000"]).collect())
    assert some == sorted(d for _, c, p, d in rows if (c == 4 and 100 <= p <= 2_000_000) or (c == 23 and p >= 1_500_000))
    bgzf.write_bgzf(df.where("false"), F.col("line"), f"file://{tmp_path}/none")
    assert bgzf.read_bgzf(spark, f"file://{tmp_path}/none").count() == 0


def call(sample, chrom, pos, gt="0/1", flt="PASS", qual=1.0):
    return (sample, f"chr{chrom}", chrom, pos, "r", "A", ["C"], qual, flt, "i", "GT", [gt])


CALL = "sample_id int, chrom string, chrom_num int, pos long, id string, ref string, alts array<string>, qual double, filter string, info string, format string, texts array<string>"


def test_delta_merge(spark, tmp_path):
    store, merged, keep = f"file://{tmp_path}/store", f"file://{tmp_path}/merged", F.col("filter") == "PASS"
    one = [call(1, 1, p) for p in (5, 150, 250, 950)] + [call(2, 2, 150)]
    two = [call(1, 1, 150, "1/1"), call(2, 1, 160), call(2, 2, 150, flt="q10")]
    add = lambda rows, i: delta.delta_merge(spark.createDataFrame(rows, CALL), store, merged, 2, i, 100, keep)
    got = lambda: [tuple(r) for r in delta.read_merged(spark, merged).collect()]
    assert add(one, 1) == [(1, 0), (1, 1), (1, 2), (1, 9), (2, 1)] and len(got()) == 5
    before = sorted(f for f in spark.read.parquet(merged).inputFiles() if "bin=1/" not in f)
    assert add(two, 2) == [(1, 1), (2, 1)]
    want = merge.merge_tped(incremental.current(spark.read.parquet(store).drop("bin")), 2, keep=keep)
    assert got() == [tuple(r) for r in want.collect()] and [r[2] for r in got()] == [5, 150, 160, 250, 950]  # the last call at chr2 no longer passes
    # Bins that weren't touched are neither read nor written.
    assert before == sorted(f for f in spark.read.parquet(merged).inputFiles() if "bin=1/" not in f)
    read = delta.store_in_bins(spark, store, [(1, 1)])
    assert read.count() == 3 and "PartitionFilters" in (plan := read._jdf.queryExecution().toString()) and "bin" in plan.split("PartitionFilters")[1][:200]
    again = got()
    assert add(two, 2) == [(1, 1), (2, 1)] and got() == again and spark.read.parquet(store).count() == 8  # a batch that is run again


def test_bins_are_bounded(spark, tmp_path, monkeypatch):
    far = spark.read.parquet(f"{SF}/lineitem.parquet").withColumn("l_orderkey", F.col("l_orderkey") * 977)
    far.write.parquet(f"file://{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(delta, "MOST_BINS", 60)
    made, read = [], delta.read_merged
    monkeypatch.setattr(delta, "read_merged", lambda spark, path: made.append(path) or read(spark, path))
    got = catalog.QUERIES["delta_merge"](spark, f"file://{tmp_path}").collect()
    folders = spark.read.parquet(made[0]).select("chrom_num", "bin").distinct().count()
    assert 22 <= folders <= 60 and len(got) > 500
    assert delta.width(spark.range(500).select(F.lit(1).alias("chrom_num"), "id").withColumnRenamed("id", "pos"), 100) == 100


def test_writers_take_raw_calls_with_one_exchange(spark, tmp_path):
    raw, best = catalog.raw(spark, SF), catalog.best()
    by = ["sample_id", "chrom_num", "pos"]
    one = merge.one_call(raw, by, best)
    assert one._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    want = merge.distinct_calls(raw, best)
    assert sorted(map(str, one.collect())) == sorted(map(str, want.collect())) and want.count() < raw.count()
    sinks.write_calls(raw, f"file://{tmp_path}/t", best=best)
    sinks.write_calls(merge.decoded(want), f"file://{tmp_path}/u")
    assert sorted(map(str, spark.read.text(f"file://{tmp_path}/t").collect())) == sorted(map(str, spark.read.text(f"file://{tmp_path}/u").collect()))
    lines = bz2.open(next((tmp_path / "t" / "sample_id=3").glob("part-*.bz2")), "rt").read().splitlines()
    assert (at := [(vcf_number(x.split("\t")[0]), int(x.split("\t")[1])) for x in lines]) == sorted(at)


def vcf_number(name):
    return {"X": 23, "Y": 24, "XY": 25, "M": 26}.get(name[3:]) or int(name[3:])


def test_lines_are_split_once(spark, tmp_path):
    (tmp_path / "1.vcf").write_text("\n".join(LINES))
    for f in (vcf.read_vcf(spark, f"file://{tmp_path}"), vcf.rejected(vcf.lines(spark, f"file://{tmp_path}").withColumn("sample_id", F.lit(1)))):
        assert f._jdf.queryExecution().optimizedPlan().toString().count("\\s+") == 1
    names = spark.createDataFrame([(x,) for x in ("chr1", "CHR22", "cHrx", "chr", "ch1", "", "xchr1", "chrchr1", "MT", " 7", None)], "c string")
    assert [r[0] for r in names.select(catalog.V.chrom_num(F.col("c"))).collect()] == [1, 22, 23, None, None, None, None, None, 26, 7, None]


def test_stored_blocks_are_merged_without_an_exchange(spark, tmp_path):
    calls = spark.createDataFrame([call(s, 1, p, random.Random(p * s).choice(["0/1", "1/1"])) for s in range(1, 7) for p in range(1, 60) if (p + s) % 3], CALL)
    blocks, names = [], []
    for i, low in enumerate((1, 3, 5)):
        part = calls.where(F.col("sample_id").between(low, low + 1)).withColumn("sample_id", F.col("sample_id") - (low - 1))
        blocks.append((merge.merge_tped(part, 2), 2))
        names.append((f"kept_block_{i}", 2))
        spark.sql(f"drop table if exists kept_block_{i}")
        spark.sql("drop table if exists kept_two")
        merge.store_block(blocks[-1][0], names[-1][0], 4, f"file://{tmp_path}/b{i}")
    two = merge.merge_stored(spark, *names[:2])
    merge.store_block(two, "kept_two", 4, f"file://{tmp_path}/two", dealt=True)
    got = merge.merge_stored(spark, ("kept_two", 4), names[2])
    for plan in (two, got):
        assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    assert len(spark.table("kept_two").inputFiles()) == 4
    want = merge.merge_blocks(blocks)
    assert sorted(map(tuple, got.collect())) == [tuple(r) for r in want.collect()]


def test_genotypes_are_decoded_behind_the_exchange(spark):
    for f in (merge.merge_tped, merge.merge_vcf):
        plan = f(catalog.raw(spark, SF), 7, best=catalog.best())._jdf.queryExecution().executedPlan().toString()
        head, tail = plan.split("Exchange rangepartitioning", 1)
        assert plan.count("Exchange") == 1 and "regexp_extract" in head and "regexp_extract" not in tail
    rows = [call(s, 1, p, g) for s, p, g in [(1, 5, "0/1"), (1, 5, "1/1"), (2, 5, "./."), (2, 6, "1")]]
    text = spark.createDataFrame(rows, CALL)
    assert merge.merge_tped(text, 2).collect() == merge.merge_tped(merge.decoded(text), 2).collect()


LINES = ["#CHROM", "", "chr1\t5\tr\tA\tC\t9\tPASS\ti\tGT\t0/1", "chrUn\t5\tr\tA\tC\t9\tPASS\ti\tGT\t0/1", "1\tx\tr\tA\tC\t9\tPASS\ti\tGT\t0/1", "1\t5\tr", "  "]


def test_rejected_lines(spark):
    text = spark.createDataFrame([(x, i) for x in LINES for i in (1, None)], "value string, sample_id int")
    got = sorted((r["reason"], r["sample_id"] or 0) for r in vcf.rejected(text).collect())
    assert got == [("contig", 0), ("contig", 1), ("fields", 0), ("fields", 1), ("position", 0), ("position", 1), ("sample", 0)]
    assert [tuple(r) for r in vcf.parse_checked(text).select("sample_id", "pos").collect()] == [(1, 5)]


def test_stream_keeps_rejected_lines_apart(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("1.vcf", "nobody.vcf"):
        (tmp_path / "in" / name).write_text("\n".join(LINES))
    paths = [f"file://{tmp_path}/{x}" for x in ("in", "store", "state", "rejects")]
    incremental.follow(spark, *paths[:3], rejects=paths[3]).awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(paths[1]).select("sample_id", "pos").collect()] == [(1, 5)]
    bad = spark.read.text(paths[3])
    assert sorted((r["reason"], r["value"].split("\t")[0]) for r in bad.collect()) == sorted([("contig", x) for x in ("1.vcf", "nobody.vcf")] + [("fields", x) for x in ("1.vcf", "nobody.vcf")] + [("position", x) for x in ("1.vcf", "nobody.vcf")] + [("sample", "nobody.vcf")])


def test_sketch_points_are_within_their_bound(spark):
    calls = spark.range(200_000).select(F.lit(1).alias("chrom_num"), (F.pmod(F.xxhash64("id"), F.lit(1_000_003))).alias("pos"), F.lit(1).alias("sample_id"))
    for accuracy in (100, 1000):
        points = partition.sketch_points(calls, 4, accuracy).collect()
        for r in points:
            rank = calls.where(F.col("pos") <= r["pos"]).count()
            assert abs(rank - 50_000 * r["part"]) <= 200_000 / accuracy + 1
        assert [r["part"] for r in points] == [1, 2, 3]


def test_sketch_points_are_exact(spark):
    # Many calls of one position, and more calls than the sketch is accurate for.
    pos = F.when(F.col("id") % 7 == 0, 5000).otherwise(F.pmod(F.xxhash64("id"), F.lit(9_001)))
    calls = spark.range(60_000).select((F.col("id") % 3 + 1).cast("int").alias("chrom_num"), pos.alias("pos")).union(spark.sql("select 9, id from range(3)"))
    by = {}
    for r in calls.collect():
        by.setdefault(r["chrom_num"], []).append(r["pos"])
    for regions, accuracy in ((4, 50), (7, 10_000)):
        want = sorted((c, k, sorted(v)[-(-len(v) * k // regions) - 1]) for c, v in by.items() for k in range(1, regions))
        assert sorted(map(tuple, partition.sketch_points(calls, regions, accuracy).collect())) == want


def test_sampled_points_take_all_calls(spark):
    got = sorted(map(tuple, catalog.QUERIES["sampled_points"](spark, SF).collect()))
    assert got and got == sorted(map(tuple, catalog.QUERIES["split_points"](spark, SF).collect()))
    assert "md5" not in catalog.ORACLE_SQL["sampled_points"]


def test_counts_of_a_load(spark, tmp_path):
    calls = merge.decoded(spark.createDataFrame([call(1, c, p) for c in (1, 3) for p in range(5 * c)], CALL)).repartition(3)
    assert sinks.write_store_counted(calls, f"file://{tmp_path}/s") == {1: 5, 3: 15} and spark.read.parquet(f"file://{tmp_path}/s").count() == 20


def test_tiles_are_bounded_by_their_width(spark):
    rows = [call(s, 1, p, "1/1" if s % 2 else "0/1") for p in (5, 9) for s in [1, 2, 999, 1000, 1001, 50_000, 99_999, 100_000]] + [call(s, 1, 7) for s in range(1, 3001)]
    calls = spark.createDataFrame(rows, CALL)
    tiles = merge.merge_tiles(calls, 100_000, 1000)
    got = tiles.select("pos", "block", F.size("cells").alias("n")).collect()
    assert max(r["n"] for r in got) <= 1000 and len(got) == 2 * 4 + 3
    assert tiles._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    few = calls.where("sample_id <= 1001")
    assert merge.from_tiles(merge.merge_tiles(few, 1001, 10), 1001).collect() == merge.merge_tped(few, 1001).collect()
    assert merge.from_tiles(merge.merge_tiles(few.where("false"), 5, 2), 5).count() == 0


def test_compaction(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    calls = merge.decoded(spark.createDataFrame([call(s, c, p, qual=float(p)) for s in (1, 2) for c in (1, 2) for p in range(1, 400)], CALL))
    for i in range(4):
        sinks.write_store(calls.where((F.col("pos") % 4 == i) | ((F.col("chrom_num") == 1) & (F.col("pos") == 8))), path, i)
    sinks.write_store(calls.withColumn("chrom_num", F.lit(3)).coalesce(1).limit(5), path, 9)
    before = sorted(map(str, incremental.current(spark.read.parquet(path)).collect()))
    sizes = lambda: {c: [os.path.getsize(f) for f in sorted((tmp_path / "store" / f"chrom_num={c}").glob("*.parquet"))] for c in (1, 2, 3)}
    old, third = sizes(), sorted((tmp_path / "store" / "chrom_num=3").iterdir())
    target = max(map(sum, old.values())) // 2 + 1
    assert sinks.compact(spark, path, target) == [c for c in (1, 2) if len(old[c]) >= 2 * -(-sum(old[c]) // target)] and 1 in sinks_done(old, target)
    assert sorted(map(str, incremental.current(spark.read.parquet(path)).collect())) == before
    new = sizes()
    assert all(len(new[c]) < len(old[c]) and max(new[c]) < 2 * target for c in (1, 2))
    assert third == sorted((tmp_path / "store" / "chrom_num=3").iterdir())  # folders without small files stay as they are
    assert sinks.compact(spark, path, target) == []


def sinks_done(old, target):
    return [c for c in old if len(old[c]) >= 2 * -(-sum(old[c]) // target)]
