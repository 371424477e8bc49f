import gzip
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from locusframe.functions.coords import CoordinateError
from locusframe.operators import coverage
from locusframe.plans import pipeline
from locusframe.sources import bam, masks, text

VCF = """##fileformat=VCFv4.2
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tx\ty
c1\t10\t.\tA\tT\t.\t.\tQD=30;MQ=60;DB\tGT:AD\t0/1:5,5\t./.:.
c1\t20\trs1\tA\tT,G\t.\tPASS\tQD=5\tGT:AD:PL\t1|2:0,4,6:1,2,3,4,5,6\t0:9,0,0:.
"""


@pytest.fixture
def vcf(tmp_path):
    path = tmp_path / "a.vcf.gz"
    path.write_bytes(gzip.compress(VCF.encode()))
    return str(path)


def test_vcf(spark, vcf):
    rows = text.read_vcf(spark, vcf).orderBy("pos0").collect()
    assert [(r["chrom"], r["pos0"], r["source_id"], r["alts"], r["qd"], r["mq"], r["filters"]) for r in rows] == [("c1", 9, None, ["T"], 30.0, 60.0, []), ("c1", 19, "rs1", ["T", "G"], 5.0, None, ["PASS"])]
    a, b = rows[0]["calls"]
    assert (a["gt"], a["ad"], b["gt"], b["ad"]) == ([0, 1], [5, 5], [None, None], None)
    assert rows[1]["calls"][0]["phased"] and rows[1]["calls"][0]["pl"] == [1, 2, 3, 4, 5, 6] and rows[1]["calls"][1]["gt"] == [0]
    assert text.read_vcf(spark, vcf, samples=["y"], regions=[("c1", 15, 30)]).select(F.size("calls").alias("n")).collect()[0]["n"] == 1
    assert [r["snp_id"] for r in text.read_panel(spark, vcf).orderBy("pos0").collect()] == ["c1:9", "c1:19"]
    with pytest.raises(ValueError):
        text.read_vcf(spark, vcf, samples=["z"])


def test_vcf_round_trip(spark, vcf, tmp_path):
    first = text.read_vcf(spark, vcf)
    text.write_vcf(first, str(tmp_path / "out"), ["x", "y"])
    again = text.read_vcf(spark, str(tmp_path / "out"))
    pick = lambda df: [(r["pos0"], [c["gt"] for c in r["calls"]], [c["ad"] for c in r["calls"]]) for r in df.orderBy("pos0").collect()]
    assert pick(first)[0] == pick(again)[0]


def test_pipeline(spark, vcf):
    rows = text.read_vcf(spark, vcf)
    out, tally, _ = pipeline.run(rows, {"steps": [{"name": "hard_qc_filter"}, {"name": "maf_filter", "enabled": False}]})
    assert [t["count"] for t in tally] == [2, 1] and out.first()["pos0"] == 9
    keep = spark.createDataFrame([("c1", 19, 20)], "chrom string, start long, end long")
    _, tally, _ = pipeline.run(rows, {"steps": [{"name": "hard_qc_filter"}]}, keep=keep)
    assert (tally[1]["count"], tally[1]["rescued"]) == (2, 1)
    _, tally, _ = pipeline.run(rows, {"steps": [{"name": "hard_qc_filter", "params": {"keep_bed": None}}]}, keep=keep)
    assert tally[1]["count"] == 1
    with pytest.raises(ValueError):
        pipeline.run(rows, {"steps": [{"name": "nothing"}]})


def test_tables(spark, tmp_path):
    af = tmp_path / "af.tsv"
    af.write_text("snp_id\taf\nc:1\t0.5\n")
    with pytest.raises(CoordinateError):
        text.read_af_table(spark, str(af))
    af.write_text("#snp_coord_system=0-based\nsnp_id\taf\nc:1\t0.5\n")
    assert text.read_af_table(spark, str(af)).first()["af"] == 0.5
    with pytest.raises(ValueError):
        text.read_af_table(spark, str(af), ("snp_id", "maf"))
    blocks = tmp_path / "b.tsv"
    blocks.write_text("sample1\tsample2\tchr\tstart\tend\tdifferent\tNsnp\na\tb\t1\t5\t10\t0\t3\n")
    assert text.read_blocks(spark, str(blocks)).first()["end"] == 11
    meta = tmp_path / "m.csv"
    meta.write_text("Sample,Region\na,x\n")
    assert text.read_table(spark, str(meta), ("sample",)).columns == ["sample", "Region"]
    ad = tmp_path / "ad.txt"
    ad.write_text("c 5 A T 8,2 5,5 . 0,0\nc 9 AT A 1,1 1,1 1,1 1,1\n")
    rows = text.read_ad_table(spark, str(ad), ["a", "b", "c", "d"], snps_only=True).orderBy("sample").collect()
    assert [r["ref_ad"] for r in rows] == [8, 5, 0, 0] and [r["alt_ad"] for r in rows] == [2, 5, 0, 0]
    with pytest.raises(ValueError):
        text.read_ad_table(spark, str(ad), ["a"])
    bed = tmp_path / "x.bed"
    bed.write_text("c\t0\t600\nc\t400\t1000\n")
    assert [(r["start"], r["end"]) for r in text.read_bed(spark, str(bed)).collect()] == [(0, 1000)]
    text.write_stamped(text.read_bed(spark, str(bed)), str(tmp_path / "o"))
    assert text.first_lines(spark, str(tmp_path / "o"), 2)[0] == "#snp_coord_system=0-based"


def make_bam(reads):
    """A BAM with one reference of 2000 bases; reads: (pos, cigar, seq, flag, quality)."""
    body = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 3) + b"c1\0" + struct.pack("<i", 2000)
    for i, (pos, cigar, seq, flag, qual) in enumerate(reads):
        name = f"r{i}\0".encode()
        packed = bytes((bam.BASES.index(seq[k]) << 4) | (bam.BASES.index(seq[k + 1]) if k + 1 < len(seq) else 0) for k in range(0, len(seq), 2))
        rec = struct.pack("<iiBBHHHiiii", 0, pos, len(name), 60, 0, len(cigar), flag, len(seq), -1, -1, 0) + name
        rec += b"".join(struct.pack("<I", n << 4 | bam.OPS.index(op)) for op, n in cigar) + packed + bytes([qual] * len(seq))
        body += struct.pack("<i", len(rec)) + rec
    out = b""
    for k in range(0, len(body), 60_000):
        part = body[k : k + 60_000]
        raw = zlib.compressobj(6, zlib.DEFLATED, -15)
        data = raw.compress(part) + raw.flush()
        out += struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(data) + 25) + data + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def test_bam_depth_and_pileup(spark, tmp_path):
    reads = [(a, [("M", 100)], "A" * 100, 0, 40) for a in range(0, 1000, 100) for _ in range(10)]
    reads += [(500, [("S", 5), ("M", 50), ("D", 10), ("M", 45)], "C" * 100, 16, 10), (0, [("M", 100)], "A" * 100, 0x400, 40)]
    path = tmp_path / "x.bam"
    path.write_bytes(make_bam(reads))
    blocks = bam.read_alignments(spark, {"s": str(path)})
    lengths = bam.reference_lengths(spark, str(path))
    row = coverage.depth_summary(coverage.depth_histogram(coverage.depth_runs(blocks, lengths))).where("chrom = 'c1'").first()
    assert row["mean"] == pytest.approx((10_000 + 95) / 2000)
    assert bam.read_alignments(spark, {"s": str(path)}, min_baseq=20).count() == 100
    seen = bam.pileup(spark, {"s": str(path)}, "c1", 520)
    assert seen.count() == 11
    rev = seen.where("strand = 'rev'").first()
    assert (rev["base"], rev["seq_cycle"], rev["sc_3p"], rev["sc_5p"], rev["bq"]) == ("C", 74, 5, 0, 10)
    summary = bam.summarise_reads(seen, "C", "A").first()
    assert (summary["alt_rev"], summary["ref_fwd"], summary["vaf_rev_pct"]) == (1, 10, 100.0)


def typed(kind, values):
    code = {1: "b", 2: "h", 3: "i", 5: "f"}.get(kind)
    if kind == 7:
        data, n = values.encode(), len(values)
    else:
        data, n = struct.pack(f"<{len(values)}{code}", *values), len(values)
    head = bytes([(n << 4) | kind]) if n < 15 else bytes([0xF0 | kind]) + typed(1, [n])
    return head + data


def test_bcf(spark, tmp_path):
    from locusframe.sources import bcf

    head = '##fileformat=VCFv4.2\n##FILTER=<ID=PASS,Description="x">\n##INFO=<ID=QD,Number=1,Type=Float>\n##FORMAT=<ID=GT,Number=1>\n##FORMAT=<ID=AD,Number=R>\n##contig=<ID=c1>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tx\ty\n'
    shared = struct.pack("<iiifII", 0, 9, 1, 0.0, 2 << 16 | 1, 2 << 24 | 2) + typed(7, "rs1") + typed(7, "A") + typed(7, "T") + typed(1, [0]) + typed(1, [1]) + typed(5, [30.0])
    own = typed(1, [2]) + bytes([0x21]) + struct.pack("<4b", 2, 5, 0, -127) + typed(1, [3]) + bytes([0x22]) + struct.pack("<4h", 500, 7, -32768, -32767)
    text_ = head.encode() + b"\0"
    path = tmp_path / "x.bcf"
    path.write_bytes(gzip.compress(b"BCF\2\2" + struct.pack("<I", len(text_)) + text_ + struct.pack("<II", len(shared), len(own)) + shared + own))
    row = bcf.read_bcf(spark, str(path)).first()
    assert (row["chrom"], row["pos0"], row["source_id"], row["ref"], row["alts"], row["filters"], row["qd"]) == ("c1", 9, "rs1", "A", ["T"], ["PASS"], 30.0)
    x, y = row["calls"]
    assert (x["gt"], x["phased"], x["ad"], y["gt"], y["ad"]) == ([0, 1], True, [500, 7], [None], None)
    assert [c["sample"] for c in bcf.read_bcf(spark, str(path), samples=["y"]).first()["calls"]] == ["y"]


def test_reads(spark, tmp_path):
    from locusframe.sources import reads

    path = tmp_path / "r.fa"
    path.write_text(">c1 first\nACGT\nacgt\n>c2\nGGG\n")
    fasta = reads.read_fasta(spark, str(path))
    assert reads.fetch(fasta, "c1", 2, 6) == "GTAC" and reads.fetch(fasta, "c2", -5, 99) == "GGG"
    rows = spark.createDataFrame([("s", "r1", "rev", "C", "ACG", [40, 2, 93]), ("s", "r2", "rev", "A", "A", [1]), ("s", "r3", "fwd", "C", "A", [1])], "sample string, read string, strand string, base string, seq string, qual array<int>")
    assert [r["read"] for r in reads.alt_reads(rows, "C").collect()] == ["r1"]
    assert reads.fastq_lines(reads.alt_reads(rows, "C")).first()["value"] == "@r1\nACG\n+\nI#~"
    assert reads.alt_reads(rows, "C", include_ref=1, ref="A").count() == 2
    assert rows.select(reads.reverse_complement(F.col("seq")).alias("x")).first()["x"] == "CGT"
    assert "sample s" in reads.site_report(spark.createDataFrame([("s", 1.5)], "sample string, bq_median double"), [1, 2, 2, 30])


def test_masks_by_name(spark, tmp_path):
    core = masks.resolve_bed(spark, "builtin:pf3d7_core_regions")
    assert core.count() == 34 and core.agg(F.sum(F.col("end") - F.col("start"))).first()[0] == sum(b - a for spans in masks.PF3D7_CORE.values() for a, b in spans)
    gff = tmp_path / "genes.gff"
    line = "c1\tx\t{}\t{}\t{}\t.\t+\t.\tID={};description={}\n"
    gff.write_text("##gff-version 3\n" + line.format("protein_coding_gene", 11, 20, "g1", "rifin") + line.format("protein_coding_gene", 31, 40, "g2", "actin%2C alpha") + line.format("mRNA", 31, 40, "t", "rifin") + line.format("pseudogene", 51, 60, "g3", "unknown"))
    found = masks.paralog_genes(spark, str(gff)).orderBy("start").collect()
    assert [(r["start"], r["end"], r["name"]) for r in found] == [(10, 20, "g1|rifin"), (50, 60, "g3|unknown pseudogene")]
    assert masks.genes_of_gff(spark, str(gff)).where("gene_id = 'g2'").first()["description"] == "actin, alpha"
    for name in ("builtin:pf3d7_paralog_genes", "builtin:pf3d7_tandem_repeats", "builtin:x"):
        with pytest.raises(ValueError):
            masks.resolve_bed(spark, name)


def test_depth_engine_names():
    assert bam.resolve_engine() == bam.resolve_engine("pysam", 20) == "native"
    for name in ("mosdepth", "other"):
        with pytest.raises(ValueError):
            bam.resolve_engine(name)


def test_bgzf_members_with_and_without_sizes():
    def member(plain, sized):
        body = zlib.compressobj(6, zlib.DEFLATED, -15)
        packed = body.compress(plain) + body.flush()
        extra = struct.pack("<HBBHH", 6, 66, 67, 2, len(packed) + 25) if sized else b""
        return b"\x1f\x8b\x08" + (b"\x04" if sized else b"\x00") + b"\0\0\0\0\0\xff" + extra + packed + struct.pack("<II", zlib.crc32(plain), len(plain))

    data = member(b"abc" * 100, True) + member(b"", True) + member(b"xyz", False) + member(b"end", True)
    assert list(bam.bgzf_blocks(data)) == [b"abc" * 100, b"xyz", b"end"]
    with pytest.raises((ValueError, zlib.error)):
        list(bam.bgzf_blocks(data[:-4]))


def test_pipeline_writes_numbered_steps(spark, vcf, tmp_path):
    _, tally, _ = pipeline.run(text.read_vcf(spark, vcf), {"steps": [{"name": "hard_qc_filter"}, {"name": "maf_filter"}]}, outdir=str(tmp_path / "steps"))
    assert sorted(p.name for p in (tmp_path / "steps").iterdir()) == ["00.input", "01.hard_qc_filter", "02.maf_filter"]
    assert [t["count"] for t in tally][:2] == [2, 1] and spark.read.parquet(str(tmp_path / "steps" / "01.hard_qc_filter")).count() == 1
