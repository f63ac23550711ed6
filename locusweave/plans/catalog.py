"""Queries of the variant engine over the driver's tables, with the same results in DuckDB SQL.

Calls are derived from lineitem (n = 7 samples) by one SQL text for both engines; every query then goes through the engine's operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import variant as V
from ..operators import delta, filters, merge, partition, reshape
from ..sources import bgzf, sinks, vcf
from ..sources.scratch import scratch

N = 7

#: The raw call rows, duplicates of a sample and locus included.
RAW = """
 select cast(l_linenumber as int) sample_id, cast(l_orderkey % 26 + 1 as int) chrom_num,
  cast((l_orderkey - l_orderkey % 26)/26 as bigint) + 1 pos, concat('rs', cast(l_orderkey as varchar(20))) rs,
  substr('ACGT', cast(l_orderkey % 4 as int) + 1, 1) ref, substr('ACGT', cast((l_orderkey + 1 + l_partkey % 3) % 4 as int) + 1, 1) alt,
  cast(l_quantity as int) qual, case l_returnflag when 'A' then 'PASS' when 'N' then 'q20' else 'q10' end flt,
  concat('DP=', cast(cast(l_quantity as int) as varchar(20))) info, 'GT:DP' fmt,
  case cast(l_quantity as int) % 3 when 0 then '0/1' when 1 then '1/1' else '0|1' end gt, cast(l_quantity as int) dp,
  l_partkey p, l_suppkey x, l_extendedprice y
 from lineitem"""
CALLS = f"""select sample_id, chrom_num, pos, rs, ref, alt, qual, flt, info, fmt, gt, dp from (
 select t.*, row_number() over (partition by chrom_num, pos, sample_id order by qual desc, p desc, x desc, y desc) rn from ({RAW}) t) u where rn = 1"""


def rows(spark: SparkSession, sf_dir: str, sql: str = CALLS) -> DataFrame:
    return spark.sql(sql.replace("from lineitem", "from {lineitem}"), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def calls(spark: SparkSession, sf_dir: str, sql: str = CALLS, more: tuple[str, ...] = (), decoded: bool = True) -> DataFrame:
    """The derived rows in the engine's call schema; decoded: genotypes as structs, else as text."""
    r = rows(spark, sf_dir, sql)
    alts = F.array("alt")
    gt = F.concat_ws(":", "gt", F.col("dp").cast("string"))
    name = F.concat(F.lit("chr"), V.chrom_name(F.col("chrom_num")))
    return r.select(
        "sample_id", name.alias("chrom"), "chrom_num", "pos", F.col("rs").alias("id"), "ref", alts.alias("alts"), F.col("qual").cast("double").alias("qual"),
        F.col("flt").alias("filter"), "info", F.col("fmt").alias("format"), F.array(V.decode(gt, F.col("ref"), alts)).alias("gts") if decoded else F.array(gt).alias("texts"), *more,
    )


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw rows, for merges that remove duplicates behind their one exchange."""
    return calls(spark, sf_dir, RAW, ("p", "x", "y"), decoded=False)


def best() -> list:
    """Which of several calls of a sample and locus stays."""
    return [F.col(c).desc() for c in ("qual", "p", "x", "y")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"with calls as ({CALLS}), passed as (select * from calls where flt = 'PASS'), autosomal as (select * from passed where chrom_num <= 22) {sql}"
        return f

    return add


def autosomal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.by_chromosome(filters.by_quality(calls(spark, sf_dir), "PASS"), 1, 22)


NAME = "case chrom_num when 23 then 'X' when 24 then 'Y' when 25 then 'XY' when 26 then 'M' else cast(chrom_num as varchar) end"
GENO = "case gt when '1/1' then {k}||'/'||{k} else '0/'||{k} end || ':' || cast(dp as varchar)"


@query(f"""
 , a as (select chrom_num, pos, list_sort(list_distinct(list(alt))) alts, arg_min(rs, sample_id) id, arg_min(ref, sample_id) ref, arg_min(flt, sample_id) flt,
   arg_min(fmt, sample_id) fmt, cast(floor(cast(sum(qual) as double)/count(*)*100+0.5) as double)/100 q, string_agg(info, ';' order by sample_id) info from autosomal group by all),
 s as (select chrom_num, pos, i, coalesce({GENO.format(k="cast(list_position(a.alts, c.alt) as varchar)")}, '.') g
   from a cross join unnest(range(1, 8)) r(i) left join autosomal c on c.sample_id = r.i and c.chrom_num = a.chrom_num and c.pos = a.pos)
 select 'chr'||cast(a.chrom_num as varchar) chrom, a.chrom_num, a.pos, any_value(a.id) id, any_value(a.ref) ref, any_value(array_to_string(a.alts, ',')) alts, any_value(q) qual,
  any_value(a.flt) "filter", any_value(a.info) info, any_value(a.fmt) format, string_agg(g, ' ' order by i) genotypes
 from a join (select s.chrom_num cn, s.pos ps, i, g from s) s on a.chrom_num = s.cn and a.pos = s.ps group by a.chrom_num, a.pos""".replace("select chrom_num, pos, i, coalesce", "select a.chrom_num, a.pos, i, coalesce"))
def vcf_merge(spark, sf_dir):
    m = merge.merge_vcf(filters.by_chromosome(raw(spark, sf_dir), 1, 22), N, best=best(), keep=filters.at_least("PASS"))
    return m.withColumn("alts", F.array_join("alts", ",")).withColumn("genotypes", F.array_join("genotypes", " "))


@query("""
 , a as (select chrom_num, pos, arg_min(rs, sample_id) rs, arg_min(ref, sample_id) ref from autosomal group by all)
 select a.chrom_num, any_value(a.rs) rs, a.pos, any_value(a.ref) ref,
  string_agg(case when c.gt is null then a.ref||' '||a.ref when c.gt = '1/1' then c.alt||' '||c.alt else c.ref||' '||c.alt end, ' ' order by i) genotypes
 from a cross join unnest(range(1, 8)) r(i) left join autosomal c on c.sample_id = r.i and c.chrom_num = a.chrom_num and c.pos = a.pos group by a.chrom_num, a.pos""")
def tped_merge(spark, sf_dir):
    m = merge.merge_tped(filters.by_chromosome(raw(spark, sf_dir), 1, 22), N, best=best(), keep=filters.at_least("PASS"))
    return m.withColumn("genotypes", F.array_join("genotypes", " "))


@query("select chrom_num, pos, array_to_string(list_sort(list_distinct(list(alt))), ',') alts from calls group by all")
def alt_union(spark, sf_dir):
    return merge.merge_vcf(raw(spark, sf_dir), N, best=best()).select("chrom_num", "pos", F.array_join("alts", ",").alias("alts"))


@query("select chrom_num, pos, cast(floor(cast(sum(qual) as double)/count(*)*100+0.5) as double)/100 qual from calls group by chrom_num, pos")
def qual_weighted(spark, sf_dir):
    return merge.merge_vcf(raw(spark, sf_dir), N, best=best()).select("chrom_num", "pos", "qual")


@query("select chrom_num, pos, string_agg(info, ';' order by sample_id) info from calls group by all")
def info_concat(spark, sf_dir):
    return merge.merge_vcf(raw(spark, sf_dir), N, best=best()).select("chrom_num", "pos", "info")


@query("select sample_id, chrom_num, pos, case gt when '1/1' then alt||' '||alt else ref||' '||alt end genotype from calls")
def genotype_decode_tped(spark, sf_dir):
    return calls(spark, sf_dir).select("sample_id", "chrom_num", "pos", V.allele_pair(F.col("gts")[0], F.col("ref")).alias("genotype"))


@query("select sample_id, chrom_num, pos, case gt when '1/1' then alt||'/'||alt else ref||'/'||alt end || ':' || cast(dp as varchar) genotype from calls")
def genotype_decode_vcf(spark, sf_dir):
    g = F.col("gts")[0]
    return calls(spark, sf_dir).select("sample_id", "chrom_num", "pos", F.concat(F.array_join(g["alleles"], "/"), g["rest"]).alias("genotype"))


@query(f"select sample_id, chrom_num, pos, {GENO.format(k='''cast(list_position(['A','C','G','T'], alt) as varchar)''')} genotype from calls")
def genotype_encode(spark, sf_dir):
    every = F.array(*[F.lit(x) for x in "ACGT"])
    return calls(spark, sf_dir).select("sample_id", "chrom_num", "pos", V.encode(F.col("gts")[0], F.col("ref"), every).alias("genotype"))


@query(f"select distinct 'chr'||({NAME}) chrom, chrom_num, {NAME} name from calls")
def chrom_parse(spark, sf_dir):
    c = calls(spark, sf_dir).select("chrom").distinct()
    n = V.chrom_num(F.col("chrom"))
    return c.select("chrom", n.alias("chrom_num"), V.chrom_name(n).alias("name"))


@query("""select sample_id, lpad(cast(chrom_num as varchar), 2, '0')||'-'||lpad(cast(pos as varchar), 10, '0') locus_key,
 lpad(cast(chrom_num as varchar), 2, '0')||'-'||lpad(cast(pos as varchar), 10, '0')||'-'||lpad(cast(sample_id as varchar), 3, '0') call_key, chrom_num, pos from calls""")
def row_key(spark, sf_dir):
    k = [F.col("chrom_num"), F.col("pos")]
    c = calls(spark, sf_dir).select("sample_id", V.locus_key(*k).alias("locus_key"), V.locus_key(*k, F.col("sample_id")).alias("call_key"))
    p = V.key_parts(F.col("locus_key"))
    return c.select("*", p["chrom_num"].alias("chrom_num"), p["pos"].alias("pos"))


BASIC = 'sample_id, chrom_num, pos, rs id, flt "filter"'


def basic(df: DataFrame) -> DataFrame:
    return df.select("sample_id", "chrom_num", "pos", "id", "filter")


@query(f"select {BASIC} from calls where flt in ('PASS', 'q20')")
def quality_filter(spark, sf_dir):
    return basic(filters.by_quality(calls(spark, sf_dir), "q20"))


@query(f"select {BASIC} from calls where flt = 'PASS'")
def pass_only(spark, sf_dir):
    return basic(filters.pass_only(calls(spark, sf_dir)))


@query(f"select {BASIC} from calls where chrom_num between 3 and 24")
def chrom_range(spark, sf_dir):
    return basic(filters.by_chromosome(calls(spark, sf_dir), 3, 24))


@query(f"select {BASIC} from calls where (chrom_num = 4 and pos between 10 and 300) or (chrom_num = 23 and pos >= 100) or chrom_num = 26")
def region_filter(spark, sf_dir):
    return basic(filters.by_regions(calls(spark, sf_dir), ["chr4:10-300", "chrX:100", "M"]))


@query("select sample_id, chrom_num, pos, ref, alt, replace(gt, '0|1', '0|0') gt from calls where replace(gt, '0|1', '0|0') <> '0|0' and length(ref) = 1")
def snp_nonref_filter(spark, sf_dir):
    r = rows(spark, sf_dir).select("sample_id", "chrom_num", "pos", "ref", "alt", F.when(F.col("gt") == "0|1", "0|0").otherwise(F.col("gt")).alias("gt"))
    return filters.not_reference(filters.single_base(r))


@query(f"select {BASIC} from calls where sample_id in (2, 5)")
def sample_select(spark, sf_dir):
    return basic(filters.by_samples(calls(spark, sf_dir), [2, 5], "sample_id"))


@query("select sample_id, chrom_num, cast(trunc(cast(pos as double) * cast(1.15 as double)) as bigint) + 5 pos, '.' id, first_value(ref) over (partition by chrom_num, pos order by sample_id) ref from calls")
def ref_correct(spark, sf_dir):
    return reshape.correct_reference(calls(spark, sf_dir), 1.15, 5).select("sample_id", "chrom_num", "pos", "id", "ref")


@query("""select 'S'||cast(sample_id as varchar) sample, chrom_num, pos, ref, alt, 'N/A' info, replace(gt, '/', '|') gt from calls""")
def split_samples(spark, sf_dir):
    """The wide form of the calls is built first, then split again; absent samples are 0|0 there and go."""
    r = rows(spark, sf_dir)
    cells = F.map_from_entries(F.collect_list(F.struct("sample_id", F.struct("ref", "alt", F.translate("gt", "/", "|").alias("gt")))))
    wide = merge.by_locus(r).groupBy("chrom_num", "pos").agg(cells.alias("m"))
    long = wide.select("chrom_num", "pos", "m", F.explode(F.sequence(F.lit(1), F.lit(N))).alias("k")).select("chrom_num", "pos", F.concat(F.lit("S"), F.col("k").cast("string")).alias("sample"), F.col("m")[F.col("k")].alias("s"))
    long = long.select("sample", "chrom_num", "pos", F.coalesce("s.ref", F.lit("N")).alias("ref"), "s.alt", F.lit("DP").alias("info"), F.coalesce("s.gt", F.lit("0|0")).alias("gt"))
    return reshape.split_samples(long)


@query("""select c_custkey ordinal, cast(c_custkey as varchar) patient_id, '0 '||cast(c_custkey as varchar)||' 0 0 '||case c_mktsegment when 'BUILDING' then '1' when 'MACHINERY' then '2' else '0' end
 ||' '||case when c_acctbal < 0 then '2' when c_acctbal < 5000 then '1' else '0' end line from customer""")
def tfam(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    seg, bal = F.col("c_mktsegment"), F.col("c_acctbal")
    people = c.select(F.col("c_custkey").cast("string").alias("patient_id"), F.when(seg == "BUILDING", "M").when(seg == "MACHINERY", "F").otherwise("U").alias("gender"), F.when(bal < 0, "Case").when(bal < 5000, "Control").otherwise("-").alias("pheno"))
    return reshape.family(c.select(F.col("c_custkey").alias("ordinal"), F.col("c_custkey").cast("string").alias("patient_id")), people)


@query("select cast(row_number() over (order by s_name) as int) sample_id, s_name name from (select distinct s_name from supplier)")
def sample_dictionary(spark, sf_dir):
    return reshape.dictionary(table(spark, sf_dir, "supplier"), "s_name")


@query("select chrom_num, count(*) calls from calls group by all")
def chrom_counts(spark, sf_dir):
    return partition.chrom_counts(calls(spark, sf_dir))


LOCI = ", loci as (select chrom_num, pos, row_number() over (partition by chrom_num order by pos) rn, count(*) over (partition by chrom_num) size from (select distinct chrom_num, pos from calls))"


@query(LOCI + " select chrom_num, pos, rn from loci where rn % 7 = 0")
def systematic_sample(spark, sf_dir):
    return partition.systematic(calls(spark, sf_dir), N)


@query(LOCI + " select chrom_num, cast(rn // ((size + 1) // 4) as int) part, pos from loci where (size + 1) // 4 > 0 and rn % ((size + 1) // 4) = 0 and rn // ((size + 1) // 4) < 4")
def split_points(spark, sf_dir):
    return partition.split_points(calls(spark, sf_dir), 4)


@query(f"""
 , g as (select c, sum(len) over (order by c) - len before, sum(len) over (order by c) upto from (select unnest(range(1, 27)) c, unnest({partition.LENGTHS}) len)),
 s as (select i, i * 772071600 + 1 a, case when i = 3 then 3088286401 else (i + 1) * 772071600 end z from range(4) r(i))
 , held as (select least((g.before + least(calls.pos, greatest(g.len, 1)) - 1) // 772071600, 3) i, count(*) calls from calls join g on calls.chrom_num = g.c group by all)
 select cast(s.i as int) split, cast(p.c as int) start_chrom, cast(a - p.before as bigint) start_pos, cast(q.c as int) end_chrom, cast(z - q.before as bigint) end_pos, coalesce(held.calls, 0) calls
 from s join g p on a > p.before and a <= p.upto join g q on z > q.before and z <= q.upto left join held on s.i = held.i""".replace("(select c, sum(len)", "(select c, len, sum(len)").replace("\n , held", ", held"))
def genome_splits(spark, sf_dir):
    """Equal parts of the genome, and how many calls lie in each."""
    held = partition.in_splits(calls(spark, sf_dir), 4).groupBy("split").agg(F.count(F.lit(1)).alias("calls"))
    return partition.genome_splits(spark, 4).join(held, "split", "left").fillna(0, ["calls"])


@query(f"select {BASIC} from calls")
def sorted_calls(spark, sf_dir):
    return basic(calls(spark, sf_dir).orderBy("chrom_num", "pos", "sample_id"))


@query(f"select {BASIC} from calls")
def resort_by_sample(spark, sf_dir):
    return basic(reshape.order_by_sample(calls(spark, sf_dir), N))


@query(ORACLE_SQL["tped_merge"].split("where chrom_num <= 22)", 1)[1])
def block_merge(spark, sf_dir):
    """Samples 1-3 and 4-7 merged apart, then together."""
    c = autosomal(spark, sf_dir)
    late = c.where("sample_id > 3").withColumn("sample_id", F.col("sample_id") - 3)
    got = merge.merge_blocks([(merge.merge_tped(c.where("sample_id <= 3"), 3), 3), (merge.merge_tped(late, 4), 4)])
    return got.withColumn("genotypes", F.array_join("genotypes", " "))


@query("""select sample_id, chrom_num, pos, cast(qual as double) + case when sample_id >= 3 and sample_id <= 5 then 100 else 0 end qual from calls""")
def incremental_merge(spark, sf_dir):
    """Samples 1-5 are in the store; a later batch brings 3-7 with QUAL raised for those that were there."""
    c = calls(spark, sf_dir)
    late = c.where("sample_id >= 3").withColumn("qual", F.when(F.col("sample_id") <= 5, F.col("qual") + 100).otherwise(F.col("qual")))
    return merge.upsert(c.where("sample_id <= 5"), late).select("sample_id", "chrom_num", "pos", "qual")


@query("""
 , a as (select distinct chrom_num, pos from autosomal)
 select a.chrom_num, a.pos, cast(i as int) sample_id, c.gt is not null present from a cross join unnest(range(1, 8)) r(i)
 left join autosomal c on c.sample_id = r.i and c.chrom_num = a.chrom_num and c.pos = a.pos""")
def densify(spark, sf_dir):
    m = merge.by_locus(autosomal(spark, sf_dir)).groupBy("chrom_num", "pos").agg(F.array_sort(F.collect_set("sample_id")).alias("ids"))
    cells = F.transform("ids", lambda x: F.struct(x.alias("sample_id"), F.lit(True).alias("v")))
    return m.withColumn("cells", cells).select("chrom_num", "pos", F.posexplode(merge.dense(F.col("cells"), N, F.lit(False))).alias("i", "present")).select("chrom_num", "pos", (F.col("i") + 1).alias("sample_id"), "present")


@query("select user_id, event_id, value, cast(rn as int) rn from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) rn from events) where rn <= 10")
def latest_n(spark, sf_dir):
    return partition.latest(table(spark, sf_dir, "events"), "user_id", "ts", 10).select("user_id", "event_id", "value", "rn")


@query("""select event_id, cast(trunc(value) as int) temp, substr('0123456789', cast(user_id % 10 as int) + 1, 1) quality from events
 where value is not null and cast(trunc(value) as int) <> 9999 and user_id % 10 in (0, 1, 4, 5, 9)""")
def valid_reading(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("value").cast("int").alias("temp"), (F.col("user_id") % 10).cast("string").alias("quality"))
    return filters.valid_reading(e)


# Text and store: the calls are written to the shared folder and read again.


@query("""select sample_id, chrom_num, pos, rs id, ref, alt alts, cast(qual as double) qual, flt "filter", info, fmt format,
 case gt when '1/1' then alt||'/'||alt else ref||'/'||alt end || ':' || cast(dp as varchar) genotype from calls""")
def vcf_text(spark, sf_dir):
    path = scratch(spark, "vcf-text")
    sinks.write_calls(raw(spark, sf_dir), path, best=best())
    g = F.col("gts")[0]
    got = vcf.read_vcf(spark, path, numbered="folder").withColumn("genotype", F.concat(F.array_join(g["alleles"], "/"), g["rest"]))
    return got.select("sample_id", "chrom_num", "pos", "id", "ref", F.array_join("alts", ",").alias("alts"), "qual", "filter", "info", "format", "genotype")


@query(ORACLE_SQL["tped_merge"].split("where chrom_num <= 22)", 1)[1])
def tped_text(spark, sf_dir):
    path = scratch(spark, "tped-text")
    sinks.write_lines(merge.merge_tped(autosomal(spark, sf_dir), N), sinks.tped_line(ref=True), path, by_chromosome=True)
    return vcf.read_tped(spark, path).withColumn("genotypes", F.array_join("genotypes", " "))


@query(f"""select chrom_num, string_agg('##fileformat=VCFv4.2', ' ') filter (rn = 1) version, '#CHROM POS ID REF ALT QUAL FILTER INFO FORMAT 1 2 3 4 5 6 7' title, count(distinct pos) loci
 from (select *, row_number() over (partition by chrom_num) rn from autosomal) group by chrom_num""")
def vcf_folders(spark, sf_dir):
    """Per-chromosome VCF folders with their header: version, title line and number of loci of each."""
    path = scratch(spark, "vcf-folders")
    header = sinks.vcf_header(sinks.sample_names(N))
    merged = merge.merge_vcf(filters.by_chromosome(raw(spark, sf_dir), 1, 22), N, best=best(), keep=filters.at_least("PASS"))
    sinks.write_lines(merged, sinks.vcf_line(), path, by_chromosome=True, compression="gzip", header=header, calls=autosomal(spark, sf_dir))
    v = spark.read.text(path)
    of = lambda test: F.array_join(F.collect_list(F.when(test, F.translate("value", "\t", " "))), " ")
    return v.groupBy("chrom_num").agg(of(F.col("value").startswith("##")).alias("version"), of(F.col("value").startswith("#CHROM")).alias("title"), F.count(F.when(~F.col("value").startswith("#"), 1)).alias("loci"))


@query(f"select {BASIC} from calls where chrom_num between 4 and 9 and pos between 20 and 400")
def store_scan(spark, sf_dir):
    """Folders are pruned by chromosome, row groups by position."""
    path = scratch(spark, "store")
    sinks.write_store(calls(spark, sf_dir), path)
    return basic(filters.by_chromosome(vcf.read_store(spark, path), 4, 9).where("pos between 20 and 400"))


TAB = "chr(9)"


@query(f"""
 , s as (select 'S'||cast(sample_id as varchar) sample, * from calls)
 select sample, 'chr'||({NAME})||{TAB}||pos||{TAB}||rs||{TAB}||ref||{TAB}||alt||{TAB}||qual||{TAB}||flt||{TAB}||'N/A'||{TAB}||fmt||{TAB}||gt as value from s
 union all select distinct sample, array_to_string(['#CHROM', 'POS', 'ID', 'REF', 'ALT', 'QUAL', 'FILTER', 'INFO', 'FORMAT', sample], {TAB}) from s""")
def sample_text(spark, sf_dir):
    """One bz2 folder for each sample, all chromosomes stacked below one header."""
    path = scratch(spark, "sample-text")
    name = F.concat(F.lit("chr"), V.chrom_name(F.col("chrom_num")))
    r = rows(spark, sf_dir, RAW).withColumn("sample", F.concat(F.lit("S"), F.col("sample_id").cast("string")))
    r = merge.one_call(r, ["sample", "chrom_num", "pos"], best())
    r = r.select("sample", "chrom_num", "pos", name.alias("chrom"), F.col("rs").alias("id"), "ref", "alt", "qual", F.col("flt").alias("filter"), "info", F.col("fmt").alias("format"), "gt")
    sinks.write_samples(reshape.sample_lines(reshape.split_samples(r)), path, placed=True)
    return spark.read.text(path).select("sample", "value")


CUTS = LOCI + ", cuts as (select chrom_num, pos from loci where (size + 1) // 4 > 0 and rn % ((size + 1) // 4) = 0 and rn // ((size + 1) // 4) < 4)"


@query(CUTS + f"""
 select chrom_num, pos, 'chr'||({NAME})||':'||cast(coalesce((select max(c.pos) from cuts c where c.chrom_num = l.chrom_num and c.pos <= l.pos), 1) as varchar)||'-' region from loci l""")
def region_text(spark, sf_dir):
    """Merged rows in one folder for each part of a chromosome, named by it."""
    path = scratch(spark, "region-text")
    c = raw(spark, sf_dir)
    sinks.write_regions(partition.in_parts(merge.merge_tped(c, N, best=best()), partition.split_points(c, 4), ordered=True), sinks.tped_line(ref=True), path)
    f = F.split("value", "\t")
    return spark.read.text(path).select(f[0].cast("int").alias("chrom_num"), f[3].cast("long").alias("pos"), "region")


@query("select chrom_num, pos, sample_id, rn from (select *, row_number() over (partition by chrom_num order by pos, sample_id) rn from calls) where rn % 5 = 0")
def interval_sample(spark, sf_dir):
    return partition.interval_sample(calls(spark, sf_dir), 5)


@query(ORACLE_SQL["split_points"].split("where chrom_num <= 22)", 1)[1])
def sampled_points(spark, sf_dir):
    """A sample of rate 1 cuts as all calls do."""
    return partition.split_or_sampled(calls(spark, sf_dir), 4, 1.0)


@query(ORACLE_SQL["split_points"].split("where chrom_num <= 22)", 1)[1])
def fallback_points(spark, sf_dir):
    """A sample too small to cut any chromosome: all calls are taken."""
    return partition.split_or_sampled(calls(spark, sf_dir), 4, 1e-9)


@query("""select chrom_num, k part, (select min(pos) from (select pos, row_number() over (order by pos) rn from calls c where c.chrom_num = s.chrom_num) where rn >= ceil(size * k / 4.0)) pos
 from (select chrom_num, count(*) size from calls group by all) s cross join unnest(range(1, 4)) r(k)""".replace("select chrom_num, k part,", "select chrom_num, cast(k as int) part,"))
def sketch_points(spark, sf_dir):
    """A sketch of each chromosome says near which positions its cuts lie; calls are counted there, so cuts are exact."""
    return partition.sketch_points(calls(spark, sf_dir), 4)


@query("select chrom_num, count(*) calls from calls group by all")
def load_counts(spark, sf_dir):
    """Calls of each chromosome, counted by the tasks that load the store."""
    counts = sinks.write_store_counted(calls(spark, sf_dir), scratch(spark, "store"))
    return spark.createDataFrame(list(counts.items()), "chrom_num int, calls long")


@query("select chrom_num, pos, count(distinct case when sample_id = 7 and pos % 2 = 0 then 'N' else ref end) > 1 ref_conflict from calls group by chrom_num, pos")
def ref_conflict(spark, sf_dir):
    c = calls(spark, sf_dir).withColumn("ref", F.when((F.col("sample_id") == 7) & (F.col("pos") % 2 == 0), "N").otherwise(F.col("ref")))
    return merge.merge_vcf(c, N, flag=True).select("chrom_num", "pos", "ref_conflict")


@query(f"select {BASIC} from calls where (pos % 20 <= 5 and pos < 200) or (chrom_num = 5 and pos >= 150)")
def many_regions(spark, sf_dir):
    """More regions than one filter expression holds."""
    wanted = [f"{c}:{20 * k}-{20 * k + 5}" for c in range(1, 27) for k in range(10)]
    return basic(filters.by_regions(calls(spark, sf_dir), [*wanted, "chr5:150"]))


READING = "substr('+- ', cast(event_id % 3 as int) + 1, 1)"


@query(f"""
 select station, time, temp, quality from (select lpad(cast(user_id as varchar), 6, '0')||'-00000' station, strftime(ts, '%Y%m%d%H%M') time, {READING} sign,
  cast(event_id % 10000 as int) * case {READING} when '-' then -1 else 1 end temp, substr('0123456789', cast(user_id % 10 as int) + 1, 1) quality from events)
 where sign <> ' ' and temp <> 9999 and quality in ('0', '1', '4', '5', '9')""")
def weather_text(spark, sf_dir):
    """Fixed-width records, written and read back; those whose value has no sign are malformed."""
    path = scratch(spark, "weather")
    value = F.concat(F.lit("0" * 4), F.lpad(F.col("user_id").cast("string"), 6, "0"), F.lit("00000"), F.date_format("ts", "yyyyMMddHHmm"), F.lit("0" * 60), F.expr(READING), F.lpad((F.col("event_id") % 10000).cast("string"), 4, "0"), (F.col("user_id") % 10).cast("string"))
    table(spark, sf_dir, "events").select(value.alias("value")).write.text(path)
    return filters.valid_reading(vcf.read_weather(spark, path)).select("station", F.date_format("ts", "yyyyMMddHHmm").alias("time"), "temp", "quality")


# Order of written text: line numbers within a folder, over its files in the order of their names.


def numbered(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """folder, line (from 1) and value of the written lines."""
    files = spark.read.text(path, wholetext=True).select(folder, F.col("_metadata.file_name").alias("name"), F.split(F.regexp_replace("value", "\n$", ""), "\n").alias("l"))
    before = F.coalesce(F.sum(F.size("l")).over(Window.partitionBy(folder).orderBy("name").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return files.withColumn("before", before).select(folder, "before", F.posexplode("l").alias("i", "value")).select(folder, (F.col("before") + F.col("i") + 1).alias("line"), "value")


@query("select chrom_num, row_number() over (partition by chrom_num order by pos) + 2 line, pos from (select distinct chrom_num, pos from autosomal)")
def vcf_lines(spark, sf_dir):
    """Line numbers of the loci in per-chromosome VCF folders, below two header lines."""
    path = scratch(spark, "vcf-lines")
    sinks.write_lines(merge.merge_vcf(autosomal(spark, sf_dir), N), sinks.vcf_line(), path, by_chromosome=True, header=sinks.vcf_header(sinks.sample_names(N)))
    return numbered(spark, path, "chrom_num").where(~F.col("value").startswith("#")).select("chrom_num", "line", F.split("value", "\t")[1].cast("long").alias("pos"))


@query(CUTS + f"""
 , named as (select 'chr'||({NAME})||':'||cast(coalesce((select max(c.pos) from cuts c where c.chrom_num = l.chrom_num and c.pos <= l.pos), 1) as varchar)||'-' region, pos from loci l)
 select region, row_number() over (partition by region order by pos) line, pos from named""")
def region_lines(spark, sf_dir):
    """Line numbers of the loci in region-named folders."""
    path = scratch(spark, "region-lines")
    c = raw(spark, sf_dir)
    sinks.write_regions(partition.in_parts(merge.merge_tped(c, N, best=best()), partition.split_points(c, 4), ordered=True), sinks.tped_line(ref=True), path)
    return numbered(spark, path, "region").select("region", "line", F.split("value", "\t")[3].cast("long").alias("pos"))


BAD_LINE = """case cast(pos % 6 as int) when 0 then concat('chrUn_', cast(chrom_num as varchar(3)), {t}, cast(pos as varchar(12)), {t}, 'x', {t}, ref, {t}, alt, {t}, '9', {t}, flt, {t}, info, {t}, fmt, {t}, gt)
 when 1 then concat(cast(chrom_num as varchar(3)), {t}, 'p', {t}, 'x', {t}, ref, {t}, alt, {t}, '9', {t}, flt, {t}, info, {t}, fmt, {t}, gt)
 when 2 then concat(cast(chrom_num as varchar(3)), {t}, cast(pos as varchar(12)), {t}, ref) else concat(cast(chrom_num as varchar(3)), {t}, cast(pos as varchar(12)), {t}, 'x', {t}, ref, {t}, alt, {t}, '9', {t}, flt, {t}, info, {t}, fmt, {t}, gt) end"""


@query(f"""select case cast(pos % 6 as int) when 0 then 'contig' when 1 then 'position' when 2 then 'fields' else 'sample' end reason, {BAD_LINE.format(t=TAB)} "value", count(*) n
 from calls where pos % 6 < 3 or sample_id = 7 group by all""")
def rejected_lines(spark, sf_dir):
    """Lines that are no call go to a second output with their reason: bad contigs, positions and field counts, and a folder without a sample's number."""
    path, rejects = scratch(spark, "mixed-text"), scratch(spark, "rejects")
    text = rows(spark, sf_dir).select(F.expr(BAD_LINE.format(t="'\t'").replace("varchar(3)", "string").replace("varchar(12)", "string")).alias("value"), F.when(F.col("sample_id") == 7, "none").otherwise(F.col("sample_id").cast("string")).alias("s"))
    text.write.partitionBy("s").text(path)
    read = spark.read.schema("value string, s string").text(path).select("value", F.col("s").try_cast("int").alias("sample_id"), F.col("_metadata.file_name").alias("file_name"))
    sinks.write_rejects(vcf.rejected(read), rejects)
    return spark.read.text(rejects).select("reason", F.regexp_extract("value", "(?s)^[^\t]*\t(.*)$", 1).alias("value")).groupBy("reason", "value").agg(F.count(F.lit(1)).alias("n"))


# Merged results that are kept: by bucket and by bin.


@query(ORACLE_SQL["tped_merge"].split("where chrom_num <= 22)", 1)[1])
def stored_block_merge(spark, sf_dir):
    """Samples 1-3 and 4-7 merged apart and stored alike by locus, then merged bucket by bucket."""
    c, blocks = raw(spark, sf_dir).where("chrom_num <= 22"), []
    for i, (low, high) in enumerate([(1, 3), (4, 7)]):
        path, size = scratch(spark, f"block-{i}"), high - low + 1
        one = c.where(F.col("sample_id").between(low, high)).withColumn("sample_id", F.col("sample_id") - (low - 1))
        blocks.append((path.rsplit("/", 1)[1].replace("-", "_"), size))
        merge.store_block(merge.merge_tped(one, size, best=best(), keep=filters.at_least("PASS")), blocks[-1][0], 8, path)
    return merge.merge_stored(spark, *blocks).withColumn("genotypes", F.array_join("genotypes", " "))


#: A later batch: samples 4 to 7 at the low positions, those called before with another genotype.
LATE = f"select sample_id, chrom_num, pos, rs, ref, alt, qual, flt, info, fmt, '1/1' gt, dp from ({CALLS}) late where sample_id >= 4 and pos <= 400"


@query(", e as (select * replace (case when sample_id >= 4 and pos <= 400 then '1/1' else gt end as gt) from autosomal where sample_id <= 5 or pos <= 400)"
       + ORACLE_SQL["tped_merge"].split("where chrom_num <= 22)", 1)[1].replace("autosomal", "e"))
def delta_merge(spark, sf_dir):
    """Samples 1-5 are merged; then the bins that a later batch touches are merged again. Bins of 256 positions, or wider ones where that would be too many."""
    store, merged = scratch(spark, "binned-store"), scratch(spark, "binned-merge")
    keep = filters.at_least("PASS") & F.col("chrom_num").between(1, 22)
    size = delta.width(rows(spark, sf_dir, RAW), 256)
    delta.delta_merge(calls(spark, sf_dir).where("sample_id <= 5"), store, merged, N, 1, size, keep)
    delta.delta_merge(calls(spark, sf_dir, LATE), store, merged, N, 2, size, keep)
    return delta.read_merged(spark, merged).withColumn("genotypes", F.array_join("genotypes", " "))


@query(ORACLE_SQL["region_filter"].split("where chrom_num <= 22)", 1)[1])
def bgzf_region(spark, sf_dir):
    """Regions of block-gzipped text, by its position index: only the blocks that the index names are read."""
    path = scratch(spark, "bgzf")
    c = calls(spark, sf_dir, decoded=False).withColumn("genotypes", F.col("texts"))
    bgzf.write_bgzf(c.withColumn("info", F.concat("info", F.lit(";S="), F.col("sample_id").cast("string"))), sinks.vcf_line(), path)
    got = bgzf.read_bgzf(spark, path, ["chr4:10-300", "chrX:100", "M"]).withColumn("sample_id", F.regexp_extract("value", ";S=([0-9]+)", 1).cast("int"))
    return basic(vcf.parse_calls(got, decoded=False))


@query(ORACLE_SQL["tped_merge"].split("where chrom_num <= 22)", 1)[1])
def tiled_merge(spark, sf_dir):
    """Merged in tiles of three samples, which are kept, and put together."""
    path = scratch(spark, "tiles")
    merge.merge_tiles(raw(spark, sf_dir).where("chrom_num <= 22"), N, 3, best=best(), keep=filters.at_least("PASS")).write.partitionBy("chrom_num").parquet(path)
    return merge.from_tiles(spark.read.parquet(path), N).withColumn("genotypes", F.array_join("genotypes", " "))


@query(ORACLE_SQL["store_scan"].split("where chrom_num <= 22)", 1)[1])
def compacted_scan(spark, sf_dir):
    """The store loaded in three batches, its small files packed, then scanned."""
    path = scratch(spark, "store")
    c = calls(spark, sf_dir)
    for i in range(3):
        sinks.write_store(c.where(F.col("sample_id") % 3 == i), path, i)
    sinks.compact(spark, path)
    return basic(filters.by_chromosome(vcf.read_store(spark, path), 4, 9).where("pos between 20 and 400"))


@query(ORACLE_SQL["vcf_text"].split("where chrom_num <= 22)", 1)[1])
def named_files(spark, sf_dir):
    """Per-sample files in one folder, each named by its sample, which is read from the name."""
    folders, path = scratch(spark, "sample-folders"), scratch(spark, "named-files")
    sinks.write_calls(raw(spark, sf_dir), folders, best=best())
    sinks.name_by_sample(spark, folders, path)
    vcf.check_samples(spark, path, N)
    g = F.col("gts")[0]
    got = vcf.read_vcf(spark, path).withColumn("genotype", F.concat(F.array_join(g["alleles"], "/"), g["rest"]))
    return got.select("sample_id", "chrom_num", "pos", "id", "ref", F.array_join("alts", ",").alias("alts"), "qual", "filter", "info", "format", "genotype")
