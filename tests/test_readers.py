from popspark.sources import readers, writers


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_vcf(spark, tmp_path):
    text = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\n1\t10\t.\tA\tG,T\t.\t.\t.\tDP:GT\t3:0|1\t4:./.\n1\t20\trs1\tC\tT\t.\t.\t.\tGT\t1/1\t0/2\n"
    (tmp_path / "a.vcf").write_text(text)
    got = rows(readers.vcf(spark, str(tmp_path / "a.vcf")), "locus", "ind", "a1", "a2")
    assert got == [("1_10", "s1", "A", "G"), ("1_10", "s2", None, None), ("rs1", "s1", "T", "T"), ("rs1", "s2", None, None)]


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x | North | R1\nacg\nuu\n\n>y  South\nACGTT\n")
    got = rows(readers.fasta(spark, str(tmp_path / "a.fa")), "ind", "pop", "region", "seq")
    assert got == [("x", "North", "R1", "ACGTT"), ("y", "South", None, "ACGTT")]
    assert [r.value for r in writers.fasta_lines(readers.fasta(spark, str(tmp_path / "a.fa")), 3).orderBy("value").collect()][0] == ">x | North\nACG\nTT"


def test_genepop(spark, tmp_path):
    (tmp_path / "a.gen").write_text("title\nL1, L2\nPOP\na , 0102 101103\nb , 0000 010101\nPop\nc , 0101 000101\n")
    got = rows(readers.genepop(spark, str(tmp_path / "a.gen")), "ind", "pop", "locus", "a1", "a2")
    assert got == [("a", "Pop1", "L1", 1, 2), ("a", "Pop1", "L2", 101, 103), ("b", "Pop1", "L1", None, None), ("b", "Pop1", "L2", 10, 101), ("c", "Pop2", "L1", 1, 1), ("c", "Pop2", "L2", None, None)]


def test_structure(spark, tmp_path):
    (tmp_path / "a.str").write_text("M1 M2\ni1 1 5 -9\ni1 1 6 7\ni2 2 5 8\ni2 2 5 8\n")
    got = rows(readers.structure(spark, str(tmp_path / "a.str")), "ind", "pop", "locus", "a1", "a2")
    assert got == [("i1", "1", "M1", "5", "6"), ("i1", "1", "M2", None, None), ("i2", "2", "M1", "5", "5"), ("i2", "2", "M2", "8", "8")]


def test_arlequin(spark, tmp_path):
    (tmp_path / "a.arp").write_text('[Profile]\nGenotypicData=1\nSampleName="P1"\nSampleSize=2\nSampleData={\ni1 1 10 20\n   11 ?\n}\n')
    got = rows(readers.arlequin(spark, str(tmp_path / "a.arp")), "ind", "pop", "locus", "a1", "a2")
    assert got == [("i1", "P1", "L1", "10", "11"), ("i1", "P1", "L2", None, None)]


def test_delimited_and_genotype_table(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿Ind;Pop;A;A;B;B\n"x;1";P;1;2;0;0\n\ny;Q;3;3;4;5\n')
    cells = [r.cells for r in readers.delimited(spark, str(tmp_path / "a.csv")).orderBy("row").collect()]
    assert cells[1] == ["x;1", "P", "1", "2", "0", "0"] and len(cells) == 3
    got = rows(readers.genotype_table(spark, str(tmp_path / "a.csv")), "ind", "pop", "locus", "a1", "a2")
    assert got == [("x;1", "P", "A", "1", "2"), ("x;1", "P", "B", None, None), ("y", "Q", "A", "3", "3"), ("y", "Q", "B", "4", "5")]


def test_combined_cells(spark):
    df = spark.createDataFrame([(c,) for c in ("182/186", "A|G", "AG", "180184", "180-184", "0182", "182/", "x")], "c string")
    got = [r.g for r in df.select(readers.split_genotype(df.c).alias("g")).collect()]
    assert got == [["182", "186"], ["A", "G"], ["A", "G"], ["180", "184"], ["180", "184"], ["1", "82"], None, None]
