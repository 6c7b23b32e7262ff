"""GenBank flat files as tables, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seqspark.functions.exprs import clean_sequence, reverse_complement, span_sequence, windows
from seqspark.session import dealt

#: Feature keys of the format and the types they stand for; all others are Generic.
FEATURE_TYPES = {
    "CDS": "CodingRegion", "gene": "Gene", "rep_origin": "Ori", "RBS": "RibosomeBindSite", "promoter": "Promoter",
    "terminator": "Terminator", "primer_bind": "Primer", "source": "Source", "LTR": "LongTerminalRepeat", "exon": "Exon",
    "5'UTR": "5PrimeUtr", "3'UTR": "3PrimeUtr", "misc_feature": "Generic",
}


FILES = "*.{gb,gbk,gbff}"
#: Feature ids are places of features times this, and places of their ranges; no record has room for so many.
JOIN_RANGES = 1 << 31


def read_genbank(spark: SparkSession, path: str, files: str = FILES) -> dict[str, DataFrame]:
    """``sequences``, ``features``, ``primers``, ``metadata`` and ``refs`` of a file or directory.

    Records are cut at ``//`` lines, so files are split between tasks. Each range of a join is a feature
    row; what cannot be read as a range gives a row with ``parse_error`` true and null places.
    """
    raw = spark.read.option("lineSep", "\n//").option("recursiveFileLookup", True).option("pathGlobFilter", files).text(path)
    # what follows a cut is the end of its line, of either kind
    records = raw.where(F.col("value").rlike(r"\S")).select(F.regexp_replace("value", r"\r|^\s+", "").alias("record"), F.col("_metadata.file_name").alias("file"))
    field = lambda name: F.trim(F.regexp_replace(F.regexp_extract("record", rf"(?m)^{name} +((?:.*)(?:\n {{12}}.*)*)", 1), r"\n +", " "))
    locus = F.regexp_extract("record", r"(?m)^LOCUS +(\S+)", 1)
    records = records.withColumn("name", locus).withColumn("seq_id", F.xxhash64("file", "record"))
    origin = F.regexp_extract("record", r"(?s)\nORIGIN[^\n]*\n(.*)$", 1)
    sequences = records.select(
        "seq_id", "name", "file", clean_sequence(origin).alias("seq"),
        F.when(F.regexp_extract("record", r"(?m)^LOCUS.* (circular|linear)\b", 1) == "circular", "circular").otherwise("linear").alias("topology"),
    ).withColumn("length", F.length("seq"))
    block = F.regexp_extract("record", r"(?s)\nFEATURES[^\n]*\n(.*?)(?=\nORIGIN|\nBASE COUNT|$)", 1)
    items = records.select("seq_id", F.posexplode(F.regexp_extract_all(F.concat(F.lit("\n"), block), F.lit(r"(?s)\n {5}(\S.*?)(?=\n {5}\S|$)"), F.lit(1))).alias("item", "text"))
    features = _features(items)
    primers = features.where("feature_type = 'Primer'").join(sequences.select("seq_id", F.col("seq").alias("bases")), "seq_id")
    span = span_sequence(F.col("bases"), F.col("start"), F.col("end"))
    metadata = records.select(
        "seq_id", *[F.nullif(field(n), F.lit("")).alias(n.lower()) for n in map(str.upper, HEAD)],
        F.regexp_extract("record", r"(?m)^LOCUS.* (\d{2}-[A-Z]{3}-\d{4})", 1).alias("date"),
        F.transform(F.regexp_extract_all("record", F.lit(r"(?m)^COMMENT +((?:.*)(?:\n {12}.*)*)"), F.lit(1)), lambda c: F.regexp_replace(c, r"\n +", "\n")).alias("comments"),
    )
    cited = records.select("seq_id", F.explode(F.regexp_extract_all("record", F.lit(r"(?m)^(REFERENCE.*(?:\n {2,12}.*)*)"), F.lit(1))).alias("ref"))
    part = lambda name: F.nullif(F.trim(F.regexp_replace(F.regexp_extract("ref", rf"(?m)^ {{0,3}}{name} +((?:.*)(?:\n {{12}}.*)*)", 1), r"\n +", " ")), F.lit(""))
    refs = cited.select("seq_id", *[part(n).alias(c) for n, c in (("REFERENCE", "description"), ("AUTHORS", "authors"), ("TITLE", "title"), ("JOURNAL", "journal"), ("PUBMED", "pubmed"))])
    return {
        "sequences": sequences.select("seq_id", "name", "seq", "length", "topology", "file"),
        "features": features.where("feature_type != 'Primer'"),
        "primers": primers.select("seq_id", F.col("label").alias("name"), F.when(F.col("direction") == "Reverse", reverse_complement(span)).otherwise(span).alias("seq")),
        "metadata": metadata,
        "refs": refs,
    }


def _features(items: DataFrame) -> DataFrame:
    key = F.regexp_extract("text", r"^(\S+)", 1)
    location = F.regexp_replace(F.regexp_extract("text", r"(?s)^\S+\s+(.*?)(?=\n\s+/|$)", 1), r"\s+", "")
    notes = F.transform(
        F.regexp_extract_all("text", F.lit(r"(?s)\n\s+(/[^\s=]+(?:=.*?)?)(?=\n\s+/|$)"), F.lit(1)),
        lambda q: F.struct(
            F.regexp_extract(q, r"^/([^\s=]+)", 1).alias("key"),
            F.regexp_replace(F.regexp_replace(F.regexp_extract(q, r"(?s)=(.*)$", 1), r"\n\s+", " "), '^"|"$', "").alias("value"),
        ),
    )
    types = F.create_map(*[F.lit(x) for pair in FEATURE_TYPES.items() for x in pair])
    rows = items.select("seq_id", "item", F.coalesce(F.try_element_at(types, key), F.lit("Generic")).alias("feature_type"), location.alias("location"), notes.alias("notes"))

    def note(*names: str) -> Column:
        def is_named(name: str):
            return lambda x: x["key"] == name

        return F.coalesce(*[F.get(F.filter("notes", is_named(n)), F.lit(0))["value"] for n in names])

    given = F.upper(F.coalesce(note("direction"), F.lit("")))
    direction = (
        F.when(given == "LEFT", "Reverse").when(given == "RIGHT", "Forward").when(F.contains("location", F.lit("complement")), "Reverse")
        .when(F.col("feature_type").isin("CodingRegion", "Primer"), "Forward").otherwise("None")
    )
    ranges = F.regexp_extract_all("location", F.lit(r"(<?\d+(?:\.\.>?\d+)?)"), F.lit(1))
    # taken out piece by piece: a pattern of repeated choices would nest as deep as a join is long
    readable = F.regexp_replace("location", r"complement\(|join\(|order\(|[<>]?\d+|\.\.|,|\)", "") == ""
    rows = rows.select("seq_id", "item", "feature_type", direction.alias("direction"), F.coalesce(note("label", "gene", "product", "note"), F.lit("")).alias("label"), "notes", F.when(readable & (F.size(ranges) > 0), ranges).otherwise(F.array(F.lit(""))).alias("ranges"))
    rows = rows.select("*", F.posexplode("ranges").alias("part", "range"))
    ends = F.transform(F.split(F.regexp_replace("range", "[<>]", ""), r"\.\."), lambda x: F.try_to_number(x, F.lit("999999999999")).cast("int"))
    bounds = F.when(F.col("range") != "", ends)
    return rows.select(
        "seq_id", (F.col("item").cast("long") * JOIN_RANGES + F.col("part")).alias("feature_id"), F.get(bounds, F.lit(0)).alias("start"),
        F.coalesce(F.get(bounds, F.lit(1)), F.get(bounds, F.lit(0))).alias("end"), "feature_type", "direction", "label", "notes", (F.col("range") == "").alias("parse_error"),
    )


#: The fields of a record's head that are written and read, in their order.
HEAD = ("definition", "accession", "version", "keywords", "source")


def write_genbank(
    sequences: DataFrame, features: DataFrame, path: str, sites: DataFrame | None = None, metadata: DataFrame | None = None, refs: DataFrame | None = None, mode: str = "errorifexists", compression: str = "none", parts: int | None = None
) -> None:
    """One record for each sequence. ``sites(seq_id, name, strand, start, end)`` of primers are written as
    ``primer_bind`` features; ``metadata(seq_id, definition, accession, version, keywords, source)`` and
    ``refs(seq_id, description, authors, title, journal, pubmed)`` go to the head, what is null is left out.
    Features of a record are gathered in one row, as the record itself is."""
    keys = F.create_map(*[F.lit(x) for k, v in FEATURE_TYPES.items() for x in (v, k)])
    rows = features.where("start is not null").select("seq_id", "start", "end", F.coalesce(F.try_element_at(keys, F.col("feature_type")), F.lit("misc_feature")).alias("key"), (F.col("direction") == "Reverse").alias("rev"), "label")
    if sites is not None:
        rows = rows.unionByName(sites.select("seq_id", "start", "end", F.lit("primer_bind").alias("key"), (F.col("strand") == "rev").alias("rev"), F.col("name").alias("label")))
    span = F.concat(F.col("start").cast("string"), F.lit(".."), F.col("end").cast("string"))
    line = F.concat(F.lit("     "), F.rpad("key", 16, " "), F.when(F.col("rev"), F.concat(F.lit("complement("), span, F.lit(")"))).otherwise(span), F.lit('\n                     /label="'), F.regexp_replace("label", '"', "'"), F.lit('"'))
    listed = dealt(rows, parts, "seq_id").groupBy("seq_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", line.alias("line")))).alias("f"))
    joined = dealt(sequences, parts, "seq_id").join(listed, "seq_id", "left")
    field = lambda name, title: F.when(F.col(name).isNotNull(), F.concat(F.lit("\n" + title.ljust(12)), F.col(name).cast("string")))
    head = F.lit("")
    if metadata is not None:
        heads = metadata.select("seq_id", F.concat_ws("", *[field(n, n.upper()) for n in HEAD]).alias("head"))
        joined = joined.join(dealt(heads, parts, "seq_id"), "seq_id", "left")
        head = F.coalesce("head", F.lit(""))
    if refs is not None:
        lines = ("description", "REFERENCE"), ("authors", "  AUTHORS"), ("title", "  TITLE"), ("journal", "  JOURNAL"), ("pubmed", "   PUBMED")
        cited = refs.select("seq_id", "description", F.concat_ws("", *[field(n, t) for n, t in lines]).alias("ref"))
        cited = dealt(cited, parts, "seq_id").groupBy("seq_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("description", "ref"))), lambda x: x["ref"]), "").alias("cited"))
        joined = joined.join(cited, "seq_id", "left")
        head = F.concat(head, F.coalesce("cited", F.lit("")))
    body = F.array_join(F.transform(F.coalesce("f", F.array().cast("array<struct<start:int,end:int,line:string>>")), lambda x: x["line"]), "\n")
    bases = F.transform(windows(F.col("seq"), 60, 0), lambda x, i: F.concat(F.lpad((i * 60 + 1).cast("string"), 9, " "), F.lit(" "), F.trim(F.regexp_replace(x, "(.{10})", "$1 "))))
    numbered = F.when(F.col("seq") == "", F.lit("        1")).otherwise(F.array_join(bases, "\n"))
    record = F.concat(
        F.lit("LOCUS       "), F.col("name"), F.lit(" "), F.length("seq").cast("string"), F.lit(" bp    DNA     "), F.col("topology"), head, F.lit("\nFEATURES             Location/Qualifiers\n"),
        body, F.lit("\nORIGIN\n"), numbered, F.lit("\n//"),
    )
    joined.select(record).write.mode(mode).option("compression", compression).text(path)
