from pathlib import Path

from sekvant import cli

ROW = "{t} - {tl} {q} - {ql} 1e-30 90 0.1 1 1 1e-30 {e} {s} 0.1 1 {ql} 1 90 {a} {b} 0.9 d\n"


def table(path: Path, rows):
    path.write_text("# header\n" + "".join(ROW.format(t=t, tl=300, q=q, ql=100, e=e, s=s, a=a, b=b) for t, q, s, a, b, e in rows))
    return str(path)


def test_classify(spark, tmp_path):
    one = table(tmp_path / "one.tbl", [("s1|fwd1", "Class_I/LTR/Ty1_copia/Ale:Ty1-RT", 50, 100, 180, 1e-20), ("s1|fwd1", "Class_I/LTR/Ty1_copia/Ale:Ty1-INT", 60, 10, 90, 1e-20), ("weak|fwd1", "Class_I/LTR/Ty1_copia/Ale:Ty1-RT", 50, 1, 90, 1.0)])
    two = table(tmp_path / "two.tbl", [("s1|fwd1", "RT_sire", 20, 5, 90, 1e-9), ("s2|rev2", "RT_sire", 30, 5, 90, 1e-9)])
    (tmp_path / "c.tsv").write_text("Clade\tFamily\tSystem\nsire\tCopia\tLTR\n")
    (tmp_path / "a.fa").write_text(">s1\nACGT\n>s2\nAACC\n>s3\nGG\n>weak\nTT\n")
    (tmp_path / "b.tsv").write_text("\t".join("s3 s1 90 120 1 0 1 120 5 124 1e-20 222.5 130 900 92 92 plus".split()) + "\n")
    out = tmp_path / "out"
    assert cli.main(["classify", "--out", str(out), "--database", f"a=path={one}", "--database", f"b=prefix={two}", "--clade-map", str(tmp_path / "c.tsv"), "--fasta", str(tmp_path / "a.fa"), "--similar", str(tmp_path / "b.tsv")], spark) == 0
    a = (out / "a.cls.tsv").read_text().split("\n")
    assert a[0].startswith("#TE\tOrder") and a[1] == "s1\tLTR\tCopia\tAle\tno\t+\tINT|Ale RT|Ale" and len(a[1].split("\t")) == 7 and len(a) == 3
    combined = {x.split("\t")[0]: x.split("\t") for x in (out / "combined.cls.tsv").read_text().split("\n")[1:-1]}
    assert set(combined) == {"s1", "s2", "s3"} and combined["s1"][7] == "a:LTR/Copia/Ale=1.100;b:LTR/Copia/sire=0.200"
    assert combined["s2"][1:6] == ["LTR", "Copia", "sire", "no", "-"] and combined["s3"][1:7] == ["LTR", "Copia", "unknown", "none", "?", "none"]
    gff = [x.split("\t") for x in (out / "a.dom.gff3").read_text().split("\n")[:-1]]
    assert [(x[0], x[2], x[3], x[4], x[5]) for x in gff] == [("s1", "CDS", "28", "270", "0.6"), ("s1", "CDS", "298", "540", "0.5")] and gff[0][8].startswith("ID=s1|Class_I/LTR/Ty1_copia/Ale:Ty1-INT;Name=Ale-INT;gene=INT;clade=Ale;coverage=100.0;evalue=1e-20;probability=0.9")
    table_ = (out / "a.dom.tsv").read_text().split("\n")
    assert table_[0].split("\t")[3] == "coverge" and table_[1].split("\t")[1:] == ["81", "1e-20", "100.0", "0.9", "0.6"] and len(table_) == 4
    assert (out / "a.dom.faa").read_text().startswith(">s1|Class_I/LTR/Ty1_copia/Ale:Ty1-INT ID=") and (out / "a.cls.pep").read_text().startswith(">s1#LTR/Copia/Ale#INT|Ale s1|")
    lib = (out / "cls.lib").read_text()
    assert ">s2#LTR/Copia/sire s2\nGGTT" in lib and ">weak#Unknown weak\nTT" in lib


def test_genome_counts_agree(spark, tmp_path):
    one = table(tmp_path / "one.tbl", [("c1:101-400|fwd1", "Class_I/LTR/Ty1_copia/Ale:Ty1-RT", 50, 10, 30, 1e-20), ("c1:101-400|fwd1", "Class_I/LTR/Ty1_copia/SIRE:Ty1-RT", 40, 12, 30, 1e-20), ("c1:101-400|rev1", "Class_I/LTR/Ty1_copia/Ale:Ty1-GAG", 50, 1, 5, 1e-20)])
    (tmp_path / "w.fa").write_text(">c1:101-400\n" + "A" * 300 + "\n")
    out = tmp_path / "out"
    cli.main(["genome", "--out", str(out), "--database", f"a=path={one}", "--fasta", str(tmp_path / "w.fa")], spark)
    gff = (out / "genome.gff3").read_text().split("\n")[:-1]
    assert gff[0] == "##gff-version 3" and len(gff) == 3
    cells = gff[1].split("\t")
    assert cells[0] == "c1" and cells[2:5] == ["CDS", "128", "190"] and "Classification=LTR/Copia/Ale;" in cells[8] and "evalue=1e-30;" in cells[8]
    summary = [x.split("\t") for x in (out / "genome.summary.tsv").read_text().split("\n")[:-1]]
    assert summary[0] == ["Order", "Superfamily", "Clade", "Number", "Total_length", "Mean_length"] and summary[-1][:4] == ["Total", "", "", "2"] and ["", "Copia", "", "2"] in [x[:4] for x in summary]
    faa = (out / "genome.dom.faa").read_text()
    assert ">c1:128-190|Class_I/LTR/Ty1_copia/Ale:Ty1-RT#LTR/Copia/Ale\n" + "K" * 21 + "\n" in faa and not (out / "genome.dom.fna").exists()


def test_translate_and_windows(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">s x\natgnnn\n")
    assert cli.main(["translate", "--fasta", str(tmp_path / "a.fa"), "--out", str(tmp_path / "aa")], spark) == 0
    assert ">s|fwd1\nMX\n" in (tmp_path / "aa").read_text()
    cli.main(["windows", "--fasta", str(tmp_path / "a.fa"), "--out", str(tmp_path / "w"), "--size", "3", "--overlap", "1"], spark)
    assert (tmp_path / "w").read_text() == ">s:1-4\nATGN\n>s:4-6\nNNN\n"


def test_facets_and_folders(spark, tmp_path):
    screen = table(tmp_path / "s.tbl", [("s1|fwd1", "A-x:A-RT__sub_0-96", 40, 1, 30, 1e-9)])
    full = table(tmp_path / "f.tbl", [("s1|fwd1", "A-x:A-RT", 50, 1, 30, 1e-9), ("s1|rev1", "A-x:A-RT", 20, 1, 30, 1e-9)])
    (tmp_path / "a.fa").write_text(">s1\n" + "ACG" * 40 + "\n")
    out = tmp_path / "out"
    assert cli.main(["facets", "--out", str(out), "--screen", screen, "--full", full, "--fasta", str(tmp_path / "a.fa"), "--parts"], spark) == 0
    lines = [x for p in sorted((out / "stages.tsv").glob("part-*")) for x in p.read_text().split("\n") if x]
    assert lines[0].startswith("stage\ttarget_name") and [x.split("\t")[:2] for x in lines[1:]] == [["fallback", "s1|rev1"], ["verified", "s1|fwd1"]]
    tiers = [x for p in sorted((out / "facets.tsv").glob("part-*")) for x in p.read_text().split("\n") if x]
    assert tiers[1].split("\t")[:4] == ["s1|fwd1", "RT", "A-x:A-RT", "40.0"] and tiers[1].split("\t")[6] == "yes"
