"""Round trips of files, and streaming ingestion."""

from seqspark.sources.fasta import read_fasta, write_fasta
from seqspark.sources.genbank import read_genbank, write_genbank
from seqspark.sources.tables import load_tables, read_sequences, save_tables
from seqspark.streaming.ingest import annotate_stream

GENBANK = """LOCUS       pTest        60 bp    DNA     circular SYN 02-JAN-2020
DEFINITION  A small
            plasmid.
ACCESSION   X1
COMMENT     first
REFERENCE   1  (bases 1 to 60)
  AUTHORS   Someone,A.
  TITLE     A title that
            goes on
  JOURNAL   Unpublished
   PUBMED   123
FEATURES             Location/Qualifiers
     source          1..60
                     /organism="none"
     CDS             complement(join(5..10,15..20))
                     /label="my cds"
                     /note="a note over
                     two lines"
     rep_origin      30..40
                     /direction=LEFT
     primer_bind     complement(1..12)
                     /label="rev primer"
     promoter        bond(12,13)
                     /label="odd"
ORIGIN
        1 acgtacgtac ggttnnaacc acgtacgtac ggttccaacc acgtacgtac ggttccaacc
//
"""


def test_fasta(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fa").write_text(">one first > record\nACGT\nNNac\n>two\nttt\n\n>three no bases\n")
    rows = {r["name"]: r for r in read_fasta(spark, str(tmp_path / "in")).collect()}
    assert {k: (r["description"], r["seq"]) for k, r in rows.items()} == {"one": ("first > record", "acgtac"), "two": ("", "ttt"), "three": ("no bases", "")}
    long = spark.createDataFrame([("x", "acgt" * 50, "d"), ("y", "a", "")], "name string, seq string, description string")
    write_fasta(long, str(tmp_path / "out.fa"))
    for part in (tmp_path / "out.fa").glob("part-*"):
        part.rename(str(part).removesuffix(".txt") + ".fa")
    back = {r["name"]: r["seq"] for r in read_fasta(spark, str(tmp_path / "out.fa")).collect()}
    assert back == {"x": "acgt" * 50, "y": "a"}


def test_genbank(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.gb").write_text(GENBANK + GENBANK.replace("pTest", "pOther").replace("circular", "linear"))
    tables = read_genbank(spark, str(tmp_path / "in"))
    seqs = {r["name"]: r for r in tables["sequences"].collect()}
    assert set(seqs) == {"pTest", "pOther"} and seqs["pTest"]["topology"] == "circular" and seqs["pOther"]["topology"] == "linear" and seqs["pTest"]["length"] == 58
    own = [r for r in tables["features"].collect() if r["seq_id"] == seqs["pTest"]["seq_id"]]
    assert sorted((r["feature_type"], r["start"], r["end"], r["direction"]) for r in own if not r["parse_error"]) == [("CodingRegion", 5, 10, "Reverse"), ("CodingRegion", 15, 20, "Reverse"), ("Ori", 30, 40, "Reverse"), ("Source", 1, 60, "None")]
    assert [r["label"] for r in own if r["parse_error"]] == ["odd"]
    notes = next({n["key"]: n["value"] for n in r["notes"]} for r in own if r["start"] == 5)
    assert notes["note"] == "a note over two lines"
    primer = [r for r in tables["primers"].collect() if r["seq_id"] == seqs["pTest"]["seq_id"]]
    assert [(r["name"], r["seq"]) for r in primer] == [("rev primer", "ccgtacgtacgt")]
    meta = tables["metadata"].where("accession = 'X1'").first()
    assert meta["definition"] == "A small plasmid." and meta["date"] == "02-JAN-2020" and meta["comments"] == ["first"]
    ref = tables["refs"].first()
    assert (ref["authors"], ref["title"], ref["pubmed"]) == ("Someone,A.", "A title that goes on", "123")


def test_genbank_round_trip(spark, tmp_path):
    seqs = spark.createDataFrame([(1, "one", "acgt" * 40, "circular"), (2, "two", "ttt", "linear")], "seq_id long, name string, seq string, topology string")
    feats = spark.createDataFrame([(1, 1, 5, 9, "CodingRegion", "Reverse", "a"), (1, 2, 150, 3, "Ori", "None", "b")], "seq_id long, feature_id long, start int, end int, feature_type string, direction string, label string")
    sites = spark.createDataFrame([(1, "p", "fwd", 20, 31)], "seq_id long, name string, strand string, start int, end int")
    write_genbank(seqs, feats, str(tmp_path / "gb"), sites)
    for part in (tmp_path / "gb").glob("part-*"):
        part.rename(str(part).removesuffix(".txt") + ".gb")
    back = read_genbank(spark, str(tmp_path / "gb"))
    assert {r["name"]: (r["seq"], r["topology"]) for r in back["sequences"].collect()} == {"one": ("acgt" * 40, "circular"), "two": ("ttt", "linear")}
    assert sorted((r["start"], r["end"], r["feature_type"], r["direction"], r["label"]) for r in back["features"].collect()) == [(5, 9, "CodingRegion", "Reverse", "a"), (150, 3, "Ori", "None", "b")]
    assert [(r["name"], r["seq"]) for r in back["primers"].collect()] == [("p", ("acgt" * 40)[19:31])]


def test_mixed_directory_and_tables(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.gb").write_text(GENBANK)
    (tmp_path / "in" / "deep" / "b.fasta").write_text(">\nacgt\n>n2\nggg\n")
    rows = read_sequences(spark, str(tmp_path / "in"))
    assert {r["name"]: r["topology"] for r in rows.collect()} == {"pTest": "circular", "b": "linear", "n2": "linear"}
    save_tables({"sequences": rows}, str(tmp_path / "saved"), partitions=2)
    assert load_tables(spark, str(tmp_path / "saved"), ["sequences"])["sequences"].count() == 3


def test_stream_annotates_what_arrives(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lib = spark.createDataFrame([(1, "site", "Promoter", "acgttgcaacgg")], "lib_id long, name string, feature_type string, seq string")
    paths = [str(tmp_path / p) for p in ("in", "out", "checkpoint")]
    for i in range(2):
        (tmp_path / "in" / f"{i}.fa").write_text(f">s{i}\ntt{'acgttgcaacgg'}aa\n")
        annotate_stream(spark, paths[0], lib, paths[1], paths[2]).awaitTermination()
    rows = spark.read.parquet(paths[1]).collect()
    assert [(r["start"], r["end"], r["direction"]) for r in rows] == [(3, 14, "Forward")] * 2


def test_genbank_with_either_line_end(spark, tmp_path):
    record = "LOCUS       {0} 8 bp DNA circular 01-JAN-2020\nDEFINITION  {0} of two.\nFEATURES             Location/Qualifiers\n     CDS             1..6\n                     /label={0}\nORIGIN\n        1 acgt acg{1}\n//\n"
    text = record.format("p1", "t") + record.format("p2", "a")
    for name, data in (("unix", text), ("windows", text.replace("\n", "\r\n"))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.gb").write_bytes(data.encode())
        tables = read_genbank(spark, str(tmp_path / name))
        assert sorted((r["name"], r["seq"], r["topology"]) for r in tables["sequences"].collect()) == [("p1", "acgtacgt", "circular"), ("p2", "acgtacga", "circular")]
        assert sorted((r["label"], r["start"], r["end"]) for r in tables["features"].collect()) == [("p1", 1, 6), ("p2", 1, 6)]


def test_genbank_join_of_many_ranges(spark, tmp_path):
    ranges = ",".join(f"{i}..{i}" for i in range(1, 1503))
    lines = [f"     CDS             join({ranges})", '                     /label="long"', "     gene            7..9", '                     /label="next"']
    (tmp_path / "x.gb").write_text("LOCUS       X 1600 bp DNA linear\nFEATURES             Location/Qualifiers\n" + "\n".join(lines) + "\nORIGIN\n        1 acgt\n//\n")
    rows = read_genbank(spark, str(tmp_path))["features"].collect()
    assert len(rows) == 1503 and len({r["feature_id"] for r in rows}) == 1503
