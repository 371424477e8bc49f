import gzip

import pytest

from locusframe import cli

VCF = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + "\t".join(f"s{i}" for i in range(6)) + "\n"
VCF += "".join(f"c1\t{100 * p}\t.\tA\tT\t.\t.\tQD={30 if p % 4 else 5}\tGT:AD:ADF:ADR\t" + "\t".join(f"{(p + i) % 2}/{(p * i) % 2}:{20 + i},{10 * ((p + i) % 2)}:10,5:10,5" for i in range(6)) + "\n" for p in range(1, 13))
BLOCKS = "sample1\tsample2\tchr\tstart\tend\tdifferent\tNsnp\ns0\ts1\tc1\t0\t900\t0\t9\ns1\ts2\tc1\t300\t1200\t0\t9\n"


@pytest.fixture
def files(tmp_path):
    (tmp_path / "a.vcf.gz").write_bytes(gzip.compress(VCF.encode()))
    (tmp_path / "b.tsv").write_text(BLOCKS)
    (tmp_path / "m.tsv").write_text("sample\tgroup\tregion\n" + "".join(f"s{i}\tg{i % 2}\tr{i % 2}\n" for i in range(6)))
    (tmp_path / "g.tsv").write_text("name\tchr\tstart\tend\nG\tc1\t200\t500\n")
    return lambda name: str(tmp_path / name)


def first_file(path):
    from pathlib import Path

    part = next(p for p in Path(path).iterdir() if p.name.startswith("part"))
    return gzip.decompress(part.read_bytes()).decode() if part.suffix == ".gz" else part.read_text()


def test_listing(capsys):
    assert cli.main(["--list"]) == 0 and "hard_qc_filter" in capsys.readouterr().out
    assert cli.main(["no_such"]) == 2
    assert cli.main(["--list-plain"]) == 0 and len(capsys.readouterr().out.split()) == len(cli.COMMANDS) == 28
    with pytest.raises(ValueError):
        cli.command("vcf", "again")(cli.wsaf_profile)
    for name in cli.COMMANDS:
        cli.parser(name)


def test_commands(spark, files):
    vcf, run = files("a.vcf.gz"), lambda *a: cli.main([str(x) for x in a])
    assert run("hard_qc_filter", "--input", vcf, "--output", files("qc")) == 0
    assert spark.read.parquet(files("qc")).count() == 9
    assert run("calculate_fws", "--input-vcf", vcf, "--out", files("fws")) == 0
    assert first_file(files("fws")).splitlines()[0].split("\t") == ["sample", "fws", "n_sites", "monoclonal"]
    assert run("compute_allele_freqs", "--bcf", vcf, "--meta", files("m.tsv"), "--output", files("af")) == 0
    assert first_file(files("af/allele_freqs.tsv.gz")).startswith("#snp_coord_system=0-based\nsnp_id")
    assert run("build_ibd_matrix", "--blocks", files("b.tsv"), "--snps", vcf, "--output", files("mx"), "--min-block-snp", 0, "--min-block-kb", 0) == 0
    assert run("analyze_ibd_matrix", "--matrix", files("mx"), "--meta", files("m.tsv"), "--output", files("an")) == 0
    assert len(first_file(files("an.per_snp.tsv.gz")).splitlines()) == 13
    assert run("ibd_gene_pairs", "--blocks", files("b.tsv"), "--genes", files("g.tsv"), "--output", files("gp"), "--min-block-snp", 0, "--min-block-kb", 0) == 0
    assert len(first_file(files("gp")).splitlines()) == 3
    assert run("strand_bias_scan", "--input-vcf", vcf, "--out-tsv", files("sb")) == 0
    assert run("wsaf_profile", "--input-vcf", vcf, "--out", files("ws"), "--min-sites", 5) == 0
    assert run("singleton_counts", "--vcf", vcf, "--output", files("sc")) == 0
    assert run("ld_decay", "--vcf", vcf, "--output", files("ld"), "--het", "dosage", "--bins", 4) == 0
    assert run("filter_pipeline", "--emit-default-config") == 0
