"""Files as records: bytes with name, size, hash and type; compression; parameter tables; annotated XML."""

from __future__ import annotations

import mimetypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

#: MIME types by extension that count here, on top of those that Python knows.
_OWN_TYPES = {
    "txt": "text/plain", "html": "text/html", "htm": "text/html", "xml": "text/xml", "naf": "text/xml", "css": "text/css", "csv": "text/csv",
    "tsv": "text/tab-separated-values", "json": "application/json", "pdf": "application/pdf", "zip": "application/zip", "gz": "application/gzip",
    "bz2": "application/x-bzip2", "xz": "application/x-xz", "png": "image/png", "jpg": "image/jpeg", "gif": "image/gif", "nt": "application/n-triples",
    "nq": "application/n-quads", "ttl": "text/turtle", "trig": "application/trig", "rdf": "application/rdf+xml", "jsonld": "application/ld+json",
    "srj": "application/sparql-results+json", "srx": "application/sparql-results+xml",
}
MIME_TYPES = {k.lstrip("."): v for k, v in mimetypes.MimeTypes(filenames=()).types_map[True].items()} | _OWN_TYPES
#: Types that compressing makes no smaller.
_COMPRESSED = ("application/zip", "application/gzip", "application/x-bzip2", "application/x-xz", "image/png", "image/jpeg", "image/gif", "application/pdf")


def mime_of(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in MIME_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(F.substring_index(name, ".", -1))), F.lit("application/octet-stream"))


def compressible(mime: Column) -> Column:
    return ~mime.isin(*_COMPRESSED)


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(name, content, size, md5, mime, modified) of every file below ``path``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    name = F.element_at(F.split("path", "/"), -1)
    return reader.load(path).select(
        name.alias("name"), "content", F.col("length").alias("size"), F.md5("content").alias("md5"), mime_of(name).alias("mime"), F.col("modificationTime").alias("modified")
    )


def upload(store: DataFrame, files: DataFrame) -> DataFrame:
    """Put (name, content) into a store of files; a file of the same name is replaced. Size, hash and type are computed.

    Of several new files of one name the one with the greatest hash stays; files without a name are left out.
    """
    hashed = files.where("name is not null").groupBy("name").agg(F.max(F.struct(F.md5("content").alias("h"), "content"))["content"].alias("content"))
    new = hashed.select("name", "content", F.octet_length("content").cast("bigint").alias("size"), F.md5("content").alias("md5"), mime_of(F.col("name")).alias("mime"))
    return store.select(*new.columns).join(new.select("name"), "name", "left_anti").unionByName(new)


def add_files(store: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Like ``upload``, but a name that exists is refused: (store, (name, status))."""
    had = store.select("name", F.lit(True).alias("had"))
    status = files.select("name").where("name is not null").distinct().join(had, "name", "left").select("name", F.when(F.col("had"), "ERROR_OBJECT_ALREADY_EXISTS").otherwise("OK_CREATED").alias("status"))
    return upload(store, files.join(store.select("name"), "name", "left_anti")), status


def remove_files(store: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    had = store.select("name", F.lit(True).alias("had"))
    status = names.select("name").distinct().join(had, "name", "left").select("name", F.when(F.col("had"), "OK_DELETED").otherwise("ERROR_OBJECT_NOT_FOUND").alias("status"))
    return store.join(names.select("name"), "name", "left_anti"), status


def as_html(text: Column) -> Column:
    """Plain text as an HTML body."""
    for char, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(code))
    return F.concat(F.lit("<pre>"), text, F.lit("</pre>"))


def download(store: DataFrame, name: str, accept: str | None = None) -> DataFrame:
    """(name, content, mime) in the accepted type: text may become HTML, HTML text; other types must match."""
    row = store.where(F.col("name") == name).select("name", "content", "mime")
    if accept in (None, "*/*"):
        return row
    text = F.col("content").cast("string")
    to_html = row.where(F.col("mime").startswith("text/") & (F.col("mime") != "text/html")).select("name", as_html(text).cast("binary").alias("content"), F.lit("text/html").alias("mime"))
    to_text = row.where(F.col("mime").startswith("text/")).select("name", "content", F.lit("text/plain").alias("mime"))
    same = row.where(F.col("mime") == accept)
    if accept == "text/html":
        return same.unionByName(to_html)
    return same.unionByName(to_text.where(F.lit(accept == "text/plain"))).dropDuplicates(["name"])


def compact(spark: SparkSession, path: str, target: str, mb: int = 128) -> None:
    """Rewrite many small files of rows as few of about ``mb`` MB, by the size of what is there."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    size = fs.getContentSummary(hadoop).getLength()
    spark.read.parquet(path).coalesce(max(1, -(-size // (mb << 20)))).write.mode("overwrite").parquet(target)


def decompress(files: DataFrame) -> DataFrame:
    """(name, content) with gzip, bzip2 and xz files unpacked, their ending cut off the name. Damaged files are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import bz2
        import gzip
        import lzma

        tools = {"gz": gzip.decompress, "bz2": bz2.decompress, "xz": lzma.decompress}
        for batch in batches:
            for name, data in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                stem, _, ending = name.rpartition(".")
                try:
                    out = (stem, tools[ending](data)) if ending in tools else (name, data)
                except (OSError, EOFError, lzma.LZMAError, ValueError):
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([out[0]]), pa.array([out[1]], pa.binary())], names=["name", "content"])

    return files.select("name", "content").where("name is not null and content is not null").mapInArrow(run, "name string, content binary")


def read_parameters(spark: SparkSession, path: str) -> DataFrame:
    """A table of parameters: tab-separated, its header names variables as ``?x``. Malformed lines are skipped."""
    head = spark.read.text(path).first()
    names = [h.strip().lstrip("?$") for h in (head[0].split("\t") if head else [])]
    lines = spark.read.text(path).where(F.col("value") != (head[0] if head else ""))
    parts = F.split("value", "\t", -1)
    return lines.where(F.size(parts) == len(names)).select(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)])


def write_parameters(df: DataFrame, path: str) -> None:
    """Gzip files with the header in each."""
    df.select(*[F.col(c).cast("string").alias(f"?{c}") for c in df.columns]).write.mode("overwrite").csv(path, sep="\t", header=True, compression="gzip", quote="")


_SPAN = "span STRUCT<target ARRAY<STRUCT<_id STRING>>>"


def read_annotations(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of annotated XML documents, one for each layer.

    headers, processors, words, terms, entities and references, coreferences, times, factualities, predicates with
    predicate_references, anchors and roles, and links. Each file is one document, named by its path; damaged files give no
    rows. Elements are read with a fixed schema. Spans are rows with a ``term`` (times: a ``word``) each.
    """

    def tag(name: str, schema: str) -> DataFrame:
        fields = Ty.StructType.fromDDL(schema)
        return spark.read.format("xml").option("rowTag", name).option("mode", "PERMISSIVE").schema(fields).load(path).withColumn("doc", F.element_at(F.split(F.input_file_name(), "/"), -1))

    targets = F.explode(F.col("span.target._id"))
    words = tag("wf", "_id STRING, _offset INT, _length INT, _sent INT, _VALUE STRING").select("doc", F.col("_id").alias("word"), F.col("_offset").alias("offset"), F.col("_length").alias("length"), F.col("_sent").alias("sent"), F.col("_VALUE").alias("text"))
    terms = tag("term", f"_id STRING, _lemma STRING, _pos STRING, {_SPAN}").select("doc", F.col("_id").alias("term"), F.col("_lemma").alias("lemma"), F.col("_pos").alias("pos"), targets.alias("word"))
    entity = tag("entity", f"_id STRING, _type STRING, references STRUCT<span ARRAY<STRUCT<target ARRAY<STRUCT<_id STRING>>>>>, externalReferences STRUCT<externalRef ARRAY<STRUCT<_resource STRING, _reference STRING, _confidence DOUBLE>>>")
    mentions = entity.select("doc", F.col("_id").alias("entity"), F.col("_type").alias("kind"), F.posexplode("references.span").alias("n", "s"))
    entities = mentions.select("doc", "entity", "kind", F.concat_ws(".", "entity", "n").alias("owner"), F.explode("s.target._id").alias("term"))
    references = entity.select("doc", F.col("_id").alias("owner"), F.posexplode("externalReferences.externalRef").alias("position", "r")).select(
        "doc", "owner", "position", F.col("r._resource").alias("resource"), F.col("r._reference").alias("reference"), F.col("r._confidence").alias("confidence")
    )
    times = tag("timex3", f"_id STRING, _type STRING, _value STRING, {_SPAN}").select("doc", F.col("_id").alias("owner"), F.col("_type").alias("kind"), F.col("_value").alias("value"), F.explode_outer("span.target._id").alias("word"))
    one_span = "span ARRAY<STRUCT<target ARRAY<STRUCT<_id STRING>>>>"
    refs = "externalReferences ARRAY<STRUCT<externalRef ARRAY<STRUCT<_resource STRING, _reference STRING>>>>"
    coref = tag("coref", f"_id STRING, _type STRING, {one_span}").select("doc", F.col("_id").alias("set_id"), F.lower("_type").alias("kind"), F.posexplode("span").alias("n", "s"))
    coreferences = coref.select("doc", "set_id", "kind", F.concat_ws(".", "set_id", "n").alias("owner"), F.explode("s.target._id").alias("term"))
    fact = tag("factuality", f"_id STRING, {_SPAN}, factVal ARRAY<STRUCT<_resource STRING, _value STRING>>")
    factualities = fact.select("doc", F.col("_id").alias("owner"), F.explode(F.col("span.target._id")).alias("term"), "factVal").select(
        "doc", "owner", "term", F.explode_outer("factVal").alias("v")
    ).select("doc", "owner", "term", F.col("v._resource").alias("resource"), F.col("v._value").alias("value"))
    role = f"role ARRAY<STRUCT<_id STRING, _semRole STRING, {_SPAN.replace('span STRUCT', 'span: STRUCT', 1)}>>"
    srl = tag("predicate", f"_id STRING, {_SPAN}, {refs}, {role}").select("doc", F.col("_id").alias("predicate"), F.col("span.target._id").alias("ids"), "externalReferences", "role")
    predicates = srl.select("doc", "predicate", F.explode("ids").alias("term"))
    flat = srl.select("doc", "predicate", F.explode("externalReferences").alias("x")).select("doc", "predicate", F.explode_outer("x.externalRef").alias("r"))
    predicate_references = flat.select("doc", "predicate", F.col("r._resource").alias("resource"), F.col("r._reference").alias("reference"))
    roles = srl.select("doc", "predicate", F.explode("role").alias("r")).select(
        "doc", "predicate", F.col("r._id").alias("owner"), F.col("r._semRole").alias("role"), F.explode(F.col("r.span.target._id")).alias("term")
    )
    anchor = tag("predicateAnchor", f"_anchorTime STRING, _beginPoint STRING, _endPoint STRING, {_SPAN}")
    anchors = anchor.select("doc", targets.alias("predicate"), F.col("_anchorTime").alias("anchorTime"), F.col("_beginPoint").alias("beginPoint"), F.col("_endPoint").alias("endPoint"))
    ends = "_id STRING, _from STRING, _to STRING, _fromType STRING, _toType STRING, _relType STRING"
    link = lambda name: tag(name, ends).select("doc", F.lit(name).alias("kind"), F.col("_id").alias("owner"), F.col("_from").alias("source"), F.col("_to").alias("target"), F.lower("_fromType").alias("from_type"), F.lower("_toType").alias("to_type"), F.upper("_relType").alias("relation"))
    described = "_title STRING, _author STRING, _creationtime STRING, _section STRING, _magazine STRING, _location STRING, _publisher STRING, _filename STRING, _filetype STRING, _pages STRING"
    lps = "linguisticProcessors ARRAY<STRUCT<_layer STRING, lp ARRAY<STRUCT<_name STRING, _version STRING, _timestamp STRING>>>>"
    header = tag("nafHeader", f"fileDesc STRUCT<{described.replace(' STRING', ': STRING')}>, public STRUCT<_publicId: STRING, _uri: STRING>, {lps}")
    headers = header.select(
        "doc", F.col("public._uri").alias("uri"), F.col("public._publicId").alias("public_id"), F.col("fileDesc._creationtime").alias("created"),
        F.lit(None).cast("string").alias("language"), F.array_distinct(F.array_compact(F.col("linguisticProcessors._layer"))).alias("layers"),
        *(F.col(f"fileDesc._{c}").alias(c) for c in ("title", "author", "section", "magazine", "location", "publisher", "filename", "filetype", "pages")),
    )
    processors = header.select("doc", F.explode("linguisticProcessors").alias("l")).select("doc", F.col("l._layer").alias("layer"), F.explode("l.lp").alias("p")).select(
        "doc", "layer", F.col("p._name").alias("name"), F.col("p._version").alias("version"), F.col("p._timestamp").alias("timestamp")
    )
    return {
        "headers": headers, "processors": processors, "words": words, "terms": terms, "entities": entities, "references": references, "coreferences": coreferences, "times": times,
        "factualities": factualities, "predicates": predicates, "predicate_references": predicate_references, "anchors": anchors, "roles": roles, "links": link("clink").unionByName(link("tlink")),
    }
