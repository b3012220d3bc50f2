"""Readers and parsers: files, JSON lines, memory documents, chunks, inventories and manifests."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as X

# Header fields of a memory document.
HEADER_FIELDS = ("kind", "status", "project", "topic", "authority", "trust", "valid_from", "valid_to", "updated_at", "supersedes", "keywords")
EXCLUDED_DIRECTORIES = ("node_modules", ".git", "dist", "build", "target", "vendor")


def scan_files(spark: SparkSession, *roots: str, pattern: str = "*", most_bytes: int = 1 << 20) -> DataFrame:
    """(uri, digest, modified, size, excluded, content): over-size and binary files are told by a reason and carry no content."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(list(roots))
    reason = exclusion_reason(F.col("path"), F.col("length"), F.col("content"), most_bytes)
    return raw.select(F.col("path").alias("uri"), F.sha2("content", 256).alias("digest"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), reason.alias("excluded"), F.when(reason.isNull(), F.decode("content", "UTF-8")).alias("content"))


def is_binary(content: Column) -> Column:
    return F.locate("00", F.hex(F.substring(content, 1, 8000))) % 2 == 1


def is_lfs_pointer(text: Column) -> Column:
    return text.startswith("version https://git-lfs.github.com/spec/")


def exclusion_reason(path: Column, size: Column, content: Column, most_bytes: int) -> Column:
    folders = F.split(path, "/")
    return F.when(size > most_bytes, "oversized").when(F.arrays_overlap(folders, X.strings(EXCLUDED_DIRECTORIES)), "excluded-directory").when(F.length(content) == 0, None).when(F.hex(F.substring(content, 1, 8000)).rlike("^(..)*00"), "binary")


def header_field(document: Column, name: str) -> Column:
    """A field of the lines before the first blank line."""
    head = F.element_at(F.split(document, r"\n\s*\n", 2), 1)
    value = F.regexp_extract(head, rf"(?mi)^{re.escape(name)}:[ \t]*(.+)$", 1)
    return F.when(value != "", F.trim(value))


def parse_memory(docs: DataFrame, uri: str = "uri", content: str = "content") -> DataFrame:
    """Header fields and body of memory documents (schema on read); the kind is upper-case on the first line."""
    c = F.col(content)
    body = F.when(c.rlike(r"\n\s*\n"), F.element_at(F.split(c, r"\n\s*\n", 2), 2)).otherwise("")
    kind = F.lower(F.regexp_extract(c, r"^\s*(MEMORY|HANDOFF|DURABLE|INCIDENT|PREFERENCE)\b", 1))
    out = [F.col(uri).alias("uri"), kind.alias("document"), body.alias("body")]
    for name in HEADER_FIELDS:
        v = header_field(c, name)
        out.append((F.transform(F.split(v, r"\s*,\s*"), lambda x: F.trim(x)) if name == "keywords" else v).alias(name))
    return docs.select(*out)


def format_memory(records: DataFrame) -> DataFrame:
    """The text that parse_memory reads: a header line, fields that are set, a blank line, the body."""
    fields = [F.when(F.col(n).isNotNull(), F.concat(F.lit(f"{n}: "), F.array_join(n, ", ") if n == "keywords" else F.col(n))) for n in HEADER_FIELDS if n in records.columns]
    return records.select("uri", F.concat(F.concat_ws("\n", F.upper("document"), *fields), F.lit("\n\n"), F.coalesce("body", F.lit(""))).alias("content"))


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a schema; broken lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def chunk_text(text: str, size: int = 2400, overlap: int = 240) -> list[tuple[str, int, str]]:
    """(heading, start, text): a new chunk at each heading; longer sections in windows that overlap and end at line ends where they can."""
    cuts = [m.start() for m in re.finditer(r"(?m)^#{1,6} ", text)]
    cuts = sorted({0, *cuts, len(text)})
    out = []
    for a, b in zip(cuts, cuts[1:]):
        section = text[a:b]
        head = section.split("\n", 1)[0].strip() if section.startswith("#") else ""
        at = 0
        while at < len(section):
            end = min(len(section), at + size)
            if end < len(section):
                line = section.rfind("\n", at + size // 2, end)
                end = line + 1 if line > 0 else end
            if section[at:end].strip():
                out.append((head, a + at, section[at:end]))
            if end >= len(section):
                break
            at = max(at + 1, end - overlap)
    return out


def chunk_documents(docs: DataFrame, uri: str = "uri", body: str = "text", size: int = 2400, overlap: int = 240) -> DataFrame:
    """(uri, ordinal, heading, start, chunk): boundaries depend on what came before, so this is a batched Python map."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(u, i, h, s, c) for u, t in zip(pdf["uri"], pdf["body"]) for i, (h, s, c) in enumerate(chunk_text(t or "", size, overlap))], columns=["uri", "ordinal", "heading", "start", "chunk"])

    return docs.select(F.col(uri).alias("uri"), F.col(body).alias("body")).mapInPandas(run, "uri string, ordinal int, heading string, start int, chunk string")


def porcelain_status(lines: DataFrame, value: str = "value") -> DataFrame:
    """NUL-separated short status entries -> (state, path)."""
    e = lines.select(F.explode(F.split(value, "\x00")).alias("e")).where("length(e) > 3")
    return e.select(F.trim(F.substring("e", 1, 2)).alias("state"), F.expr("substring(e, 4)").alias("path"))


def name_status(lines: DataFrame, value: str = "value") -> DataFrame:
    """Tab-separated name-status lines -> (state, path, previous)."""
    p = F.split(value, "\t")
    return lines.where(F.size(p) >= 2).select(F.substring(p[0], 1, 1).alias("state"), F.element_at(p, -1).alias("path"), F.when(F.size(p) == 3, p[1]).alias("previous"))


def manifest_components(files: DataFrame) -> DataFrame:
    """package.json files (path, content) -> component root, name, version and dependencies."""
    j = F.from_json("content", "name string, version string, dependencies map<string,string>, devDependencies map<string,string>")
    root = F.regexp_replace("path", r"/?package\.json$", "")
    return files.where(F.col("path").rlike(r"(^|/)package\.json$")).select(root.alias("root"), j.alias("m")).select("root", "m.name", "m.version", F.map_concat(F.coalesce("m.dependencies", F.create_map().cast("map<string,string>")), F.coalesce("m.devDependencies", F.create_map().cast("map<string,string>"))).alias("dependencies"))


def rationale_markers(files: DataFrame) -> DataFrame:
    """(path, marker, text) of WHY, NOTE, HACK, FIXME, TODO and XXX comments."""
    found = F.regexp_extract_all("content", F.lit(r"(?m)(?://|#|--|/\*|\*)\s*((?:WHY|NOTE|HACK|FIXME|TODO|XXX)\b:?.*)$"), F.lit(1))
    return files.select("path", F.explode(found).alias("t")).select("path", F.regexp_extract("t", r"^(\w+)", 1).alias("marker"), F.trim(F.regexp_replace("t", r"^\w+:?\s*", "")).alias("text"))


# Declarations by language: (kind, pattern with the name in group 1).
DECLARATIONS = {
    "typescript": (("class", r"(?m)^\s*(?:export\s+)?(?:abstract\s+)?class\s+([\w$]+)"), ("interface", r"(?m)^\s*(?:export\s+)?interface\s+([\w$]+)"), ("function", r"(?m)^\s*(?:export\s+)?(?:async\s+)?function\s+([\w$]+)"), ("type_alias", r"(?m)^\s*(?:export\s+)?type\s+([\w$]+)\s*=")),
    "python": (("class", r"(?m)^\s*class\s+(\w+)"), ("function", r"(?m)^\s*(?:async\s+)?def\s+(\w+)")),
    "protobuf": (("struct", r"(?m)^\s*message\s+(\w+)"), ("enum", r"(?m)^\s*enum\s+(\w+)"), ("interface", r"(?m)^\s*service\s+(\w+)")),
    "sql": (("struct", r"(?im)^\s*create\s+table\s+(?:if\s+not\s+exists\s+)?([\w.\"]+)"),),
    "bazel": (("module", r"name\s*=\s*\"([^\"]+)\""),),
}
LANGUAGES = {"ts": "typescript", "tsx": "typescript", "js": "typescript", "py": "python", "proto": "protobuf", "sql": "sql", "bazel": "bazel", "BUILD": "bazel"}


def extract_symbols(files: DataFrame) -> DataFrame:
    """(path, language, kind, name) of declarations, by pattern and inside whole-stage code; not a parser."""
    language = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[F.substring_index(F.substring_index("path", "/", -1), ".", -1)]
    rows = files.withColumn("language", language).where("language is not null")
    named = lambda kind, p: F.transform(F.regexp_extract_all("content", F.lit(p), F.lit(1)), lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))
    parts = [F.when(F.col("language") == lang, named(kind, p)).otherwise(F.array().cast("array<struct<kind:string,name:string>>")) for lang, ps in DECLARATIONS.items() for kind, p in ps]
    return rows.select("path", "language", F.explode(F.concat(*parts)).alias("s")).select("path", "language", "s.kind", "s.name").distinct()


def extract_imports(files: DataFrame) -> DataFrame:
    """(path, module) of import statements."""
    found = F.concat(F.regexp_extract_all("content", F.lit(r"(?m)^\s*import\s[^'\"\n]*['\"]([^'\"]+)['\"]"), F.lit(1)), F.regexp_extract_all("content", F.lit(r"(?m)^\s*from\s+([\w.]+)\s+import\b"), F.lit(1)))
    return files.select("path", F.explode(F.array_distinct(found)).alias("module"))


def schema_fields(files: DataFrame) -> DataFrame:
    """(path, key, kind) of the top-level keys of JSON documents."""
    return files.select("path", F.variant_get(F.try_parse_json("content"), "$", "map<string,variant>").alias("m")).where("m is not null").select("path", F.explode("m").alias("key", "v")).select("path", "key", F.schema_of_variant("v").alias("kind"))


def directory_listing(paths: DataFrame, folder: str = "", recursive: bool = False) -> DataFrame:
    """Entries below a folder: its direct children, or everything."""
    base = folder.rstrip("/") + "/" if folder else ""
    rest = paths.where(F.col("path").startswith(base)).select(F.expr(f"substring(path, {len(base) + 1})").alias("rest"))
    if recursive:
        return rest.select(F.concat(F.lit(base), "rest").alias("entry"), F.lit("file").alias("kind")).distinct()
    return rest.select(F.concat(F.lit(base), F.substring_index("rest", "/", 1)).alias("entry"), F.when(F.col("rest").contains("/"), "folder").otherwise("file").alias("kind")).distinct()
