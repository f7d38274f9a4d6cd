import gzip

import pytest

from helixlake.operators import annotate as an
from helixlake.operators import intervals as iv
from helixlake.operators import variants as vr
from helixlake.sources import datasources, streams, tables, writers
from helixlake.streaming import counts


def put(path, text, gz=False):
    data = text.encode()
    path.write_bytes(gzip.compress(data) if gz else data)
    return str(path)


def test_fastq(spark, tmp_path):
    datasources.register(spark)
    text = "@r1 1:N:0\nACGT\n+\nIII@\n@r2 1:N:0\nAC\nGT\n+r2 1:N:0\n@+\nII\n\n@r3\n\n+\n\n"
    put(tmp_path / "a.fastq.gz", text, gz=True)
    rows = spark.read.format("fastq").load(str(tmp_path)).orderBy("ordinal").collect()
    assert [(r["name"], r["description"], r["read_no"], r["seq"], r["qual"]) for r in rows] == [("r1", "1:N:0", 1, "ACGT", "III@"), ("r2", "1:N:0", 1, "ACGT", "@+II"), ("r3", None, None, "", "")]
    import io

    for bad in ("r1\nA\n+\nI\n", "@r\nACG\n+\nII\n", "@r\nA\n+s\nI\n", "@r\nA A\n+\nIII\n", "@r\nACG\n"):
        with pytest.raises(ValueError):
            list(streams.parse_fastq(io.BytesIO(bad.encode())))
    df = spark.createDataFrame([("x", "d", "AC", "II", 0), ("y", None, "G", "J", 1)], "name string, description string, seq string, qual string, k int")
    writers.write_fastq(df, str(tmp_path / "out"), ["k"], gz=True)
    back = spark.read.format("fastq").load(str(tmp_path / "out")).orderBy("name").collect()
    assert [(r["name"], r["description"], r["seq"], r["qual"]) for r in back] == [("x", "d", "AC", "II"), ("y", None, "G", "J")]


def test_fasta(spark, tmp_path):
    datasources.register(spark)
    path = put(tmp_path / "a.fa", ">c1 first\nACGTAC\nGTA\n>c2\n\n>c3\nacg\n")
    rows = [tuple(r) for r in spark.read.format("fasta").option("chunk", 4).load(path).orderBy("contig", "chunk").collect()]
    assert rows == [("c1", 0, 0, "ACGT"), ("c1", 1, 4, "ACGT"), ("c1", 2, 8, "A"), ("c2", 0, 0, ""), ("c3", 0, 0, "acg")]
    sizes = writers.contig_sizes(spark.read.format("fasta").load(path))
    assert sorted(map(tuple, sizes.collect())) == [("c1", 9), ("c2", 0), ("c3", 3)]
    writers.write_fasta(spark.createDataFrame([("c1", 2, 9, "GTACGTA")], "contig string, start long, end long, seq string"), str(tmp_path / "o"), 4)
    assert [r["value"] for r in spark.read.text(str(tmp_path / "o")).collect()] == [">c1:3-9", "GTAC", "GTA"]


def test_bam_and_sam(spark, tmp_path):
    datasources.register(spark)
    c = lambda *ops: [{"op": o, "len": n} for o, n in ops]
    records = [
        ("q1", 99, "chr1", 10, 22, 30, c((4, 2), (0, 5), (2, 3), (0, 4)), "ACGTACGTACG", list(range(11)), "chr1", 50),
        ("q2", 4, None, None, None, 0, [], None, None, None, None),
        ("q3", 16, "chr2", 5, 8, 7, c((0, 3)), "NAC", None, None, None),
    ]
    (tmp_path / "a.bam").write_bytes(streams.encode_bam([("chr1", 100), ("chr2", 50)], records))
    df = spark.read.format("bam").load(str(tmp_path / "a.bam"))
    got = [tuple([x.asDict() for x in v] if k == "cigar" else v for k, v in r.asDict().items()) for r in df.orderBy("qname").collect()]
    assert got == records
    assert [r["qname"] for r in df.where("contig = 'chr1' and mapq >= 20").collect()] == ["q1"]
    header = spark.read.format("bam_header").load(str(tmp_path / "a.bam"))
    assert [tuple(r)[1:] for r in header.collect()] == [("chr1", 100, 0), ("chr2", 50, 1)]
    assert datasources.consistent_contigs(header).count() == 2
    path = put(tmp_path / "a.sam", "@HD\tVN:1\nq1\t99\tchr1\t11\t30\t2S5M3D4M\t=\t51\t0\tACGTACGTACG\t!\"#$%&'()*+\nq2\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*\nq3\t16\tchr2\t6\t7\t3M\t*\t0\t0\tNAC\t*\n")
    got = [tuple([x.asDict() for x in v] if k == "cigar" else v for k, v in r.asDict().items()) for r in spark.read.format("sam").load(path).orderBy("qname").collect()]
    assert got == records


def test_annotation_files(spark, tmp_path):
    gtf = put(tmp_path / "a.gtf", '#!x\n1\tsrc\texon\t11\t20\t.\t+\t.\tgene_id "g1"; gene_name "A"; note "a b=c";\n1\tsrc\tgene\t5\t30\t0.5\t-\t0\tID=g2;Name=B\n')
    rows = tables.read_gtf(spark, gtf, prefix="chr").collect()
    assert [(r["contig"], r["start"], r["end"], r["score"], r["attributes"]) for r in rows] == [("chr1", 10, 20, None, {"gene_id": "g1", "gene_name": "A", "note": "a b=c"}), ("chr1", 4, 30, "0.5", {"ID": "g2", "Name": "B"})]
    short = put(tmp_path / "b.gtf", "1\tsrc\texon\n")
    assert tables.read_gtf(spark, short, fixed_width=False).count() == 0
    with pytest.raises(Exception, match="nine"):
        tables.read_gtf(spark, short).collect()
    assert an.name_map(tables.read_gtf(spark, gtf), an.attribute("gene_id"), an.attribute("gene_name")).first()["values"] == ["A"]
    gmt = put(tmp_path / "a.gmt", "t1\td\ta\tb\ta\nt2\td\tc\nt1\tother\tb\ta\n")
    assert sorted(map(tuple, tables.read_gmt(spark, gmt).collect())) == [("t1", "a"), ("t1", "b"), ("t2", "c")]
    with pytest.raises(Exception, match="defined twice"):
        tables.read_gmt(spark, put(tmp_path / "b.gmt", "t1\td\ta\nt1\td\tb\n")).collect()
    obo = put(tmp_path / "a.obo", "format: 1\n\n[Term]\nid: GO:1\nname: one\nnamespace: process\n\n[Typedef]\nid: x\n\n[Term]\nid: GO:2\nname: two\nnamespace: function\n")
    assert sorted(map(tuple, tables.read_obo(spark, obo).collect())) == [("GO:1", "one", "process"), ("GO:2", "two", "function")]
    gaf = put(tmp_path / "a.gaf", "!c\nDB\tg1\ts\t\tGO:1\tr\tIDA\nDB\tg1\ts\t\tGO:2\tr\tIEA\n")
    assert sorted(map(tuple, tables.read_gaf(spark, gaf, ["IDA"]).collect())) == [("g1", "GO:1")]
    res = put(tmp_path / "r.tsv", "gene\tlog2\tp\na\t1.5\t0.01\nb\t-2\t0.02\nc\t0\t0.5\nd\t1\tNA\n")
    assert sorted((r["gene"], r["query"]) for r in tables.read_results(spark, res, "gene", "p", "log2").collect()) == [("a", "pos"), ("b", "neg"), ("c", None)]
    assert sorted((r["gene"], r["query"]) for r in tables.read_results(spark, res, 0, 2).collect()) == [("a", "sig"), ("b", "sig"), ("c", None)]
    with pytest.raises(Exception, match="without change"):
        tables.read_results(spark, put(tmp_path / "z.tsv", "gene\tlog2\tp\na\t0\t0.01\n"), "gene", "p", "log2").collect()
    tr = put(tmp_path / "t.tsv", "a\tA\nb\nc\tC\n")
    assert sorted(((r[0], r[1]) for r in tables.read_translation(spark, tr).collect()), key=str) == [("a", "A"), ("b", None), ("c", "C")]


def test_places_and_matrices(spark, tmp_path):
    bed = put(tmp_path / "a.bed", "track x\nc1\t1\t5\tn\t7\t+\nc1\t8\t9\n")
    rows = [tuple(r) for r in tables.read_bed(spark, bed).collect()]
    assert rows == [("c1", 1, 5, "n", 7, "+"), ("c1", 8, 9, None, None, None)]
    assert [tuple(r) for r in tables.read_intervals(spark, put(tmp_path / "i", "c\t1\t5\tx\n"), one_based=True).collect()] == [("c", 0, 5)]
    assert [tuple(r) for r in tables.read_contigs(spark, put(tmp_path / "s", "b\t5\na\t7\n")).orderBy("ordinal").collect()] == [("b", 5, 0), ("a", 7, 1)]
    put(tmp_path / "s1.2000.r1.10.countMatrix", "c:1-10\tc:11-20\n0\t2\n2\t5\n")
    bins, cells = tables.read_matrix(spark, str(tmp_path / "s1.2000.r1.10.countMatrix"))
    assert [tuple(r)[1:] for r in bins.orderBy("bin").collect()] == [("c", 0, 10, 0), ("c", 10, 20, 1)]
    assert sorted(tuple(r)[1:] for r in cells.collect()) == [(0, 1, 2.0), (1, 0, 2.0), (1, 1, 5.0)]
    assert tuple(bins.select(tables.matrix_file_name(iv.F.col("file")).alias("x")).first()["x"]) == ("s1", "2000", "r1", "10")
    dense = writers.dense_rows(cells, bins, digits=1).orderBy("bin").collect()
    assert [(r["name"], r["row"]) for r in dense] == [("c:1-10", "0.0\t2.0"), ("c:11-20", "2.0\t5.0")]
    runs = spark.createDataFrame([("c", 5, 9, 2), ("c", 0, 5, 1)], "contig string, start long, end long, cov long")
    writers.write_bedgraph(runs, str(tmp_path / "bg"), 2)
    assert [tuple(r) for r in tables.read_bedgraph(spark, str(tmp_path / "bg")).collect()] == [("c", 5, 9, 2.0)]
    writers.write_bed(runs, str(tmp_path / "bo"))
    assert tables.read_bed(spark, str(tmp_path / "bo")).count() == 2
    assert tables.read_parameters("a 5\nb\t0.5\n# c\nd x y\n") == {"a": 5, "b": 0.5, "d": "x y"}


def test_discovery(spark, tmp_path):
    d = tmp_path / "f"
    d.mkdir()
    for n in ("s1_R1_001.fastq.gz", "s1_R2_001.fastq.gz", "s1_R1_003.fastq.gz", "s2_1.fq", "x.txt"):
        put(d / n, "x")
    found = {(r["sample"], r["fragment"]): (r["read1"] is not None, r["read2"] is not None) for r in tables.find_fastq(spark, str(d)).collect()}
    assert found == {("s1", "001"): (True, True), ("s1", "003"): (True, False), ("s2", ""): (True, False)}
    assert [r["sample"] for r in tables.fragment_gaps(tables.find_fastq(spark, str(d))).collect()] == ["s1"]
    files = spark.createDataFrame([("/a/tum.bam",), ("/a/norm1.bam",)], "path string")
    samples = spark.createDataFrame([("tum",), ("norm",)], "name string")
    assert {r["name"]: r["path"] for r in tables.files_of_samples(samples, files).collect()} == {"tum": "/a/tum.bam", "norm": "/a/norm1.bam"}
    with pytest.raises(Exception, match="exactly one"):
        tables.files_of_samples(spark.createDataFrame([("zzz",)], "name string"), files).collect()
    sheet = put(tmp_path / "sheet", "a\ti1\tNORM\nb\ti1\tTUM\n")
    assert tables.read_sample_sheet(spark, sheet).count() == 2
    log = put(tmp_path / "log.txt", "Pairs: 12\nRate 0.5\n")
    assert tuple(tables.read_metrics(spark, log, {"pairs": r"Pairs: (\d+)", "none": "zzz (x)"}).first()) == ("log.txt", "12", None)


def test_variant_context(spark):
    seq = spark.createDataFrame([("c", "ACGTaaaCGTTTTTGCACACAT")], "contig string, seq string")
    v = spark.createDataFrame([("c", 5, "A", "G"), ("c", 4, "T", "A"), ("c", 2, "C", "A")], "contig string, pos long, ref string, var string")
    assert [r["low_comp"] for r in vr.masked_context(v, seq).orderBy("pos").collect()] == ["none", "edge", "within"]
    with pytest.raises(Exception, match="reference differs"):
        vr.masked_context(spark.createDataFrame([("c", 1, "T", "G")], "contig string, pos long, ref string, var string"), seq).collect()
    v = spark.createDataFrame([("c", 10, "T", "--"), ("c", 9, "G", "GTT"), ("c", 15, "G", "GCA"), ("c", 2, "C", "A")], "contig string, pos long, ref string, var string")
    got = {r["pos"]: (r["monomer"], r["mono_ref"], r["mono_var"]) for r in vr.repeat_context(v, seq).collect()}
    assert got == {10: ("T", 5, 3), 9: ("T", 5, 7), 15: ("CA", 3, 4), 2: (None, None, None)}


def test_frequencies(spark, tmp_path):
    path = put(tmp_path / "f.tsv", "SNP\tCov\tFreq\nc:5:A:G\t12\t0.5\nc:7:A:G\t3\tNA\n")
    assert [tuple(r) for r in tables.read_snp_frequencies(spark, path, 10).collect()] == [("c", 5, 12, 0.5)]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("c", i, f"q{i % 7}") for i in range(40)], "contig string, start long, qname string")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    live = counts.read_stream(spark, str(tmp_path / "in"), rows.schema, 1)
    counts.run_to_table(counts.bin_counts(live, 10), "live_bins", str(tmp_path / "ck"))
    assert sorted(map(tuple, spark.table("live_bins").collect())) == [("c", i, 10) for i in range(4)]
    counts.run_to_parquet(counts.distinct_reads(live, ["qname"]), str(tmp_path / "out"), str(tmp_path / "ck2"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 7
