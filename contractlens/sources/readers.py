"""Scans and sinks: texts, word-processor files, web pages, JSON lines, rule and profile files, versions."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contractlens.functions.scratch import Scratch
from contractlens.functions.text import unix_lines
from contractlens.operators import furniture
from contractlens.operators import gates
from contractlens.operators import rules as rule_engine
from contractlens.operators.rulebook import PROFILES, RULES

CLAUSE = "clause_id string, doc_id string, doc_type string, text string, order int, heading string, char_start int, char_end int"
LABEL = "clause_id string, doc_id string, doc_type string, category string, risky boolean, severity string, rationale string, grounding_hint string, labeler string, labeled_at timestamp, assisted boolean, corrected boolean, split string"
SUGGESTION = "clause_id string, category string, risky boolean, severity string, rationale string, confidence double"
SUFFIXES = (".txt", ".md", ".docx", ".pdf")
#: Tags whose content is no text, tags of page chrome, and tags that end a line (fixed values).
DROPPED, CHROME = ("script", "style", "table"), ("script", "style", "nav", "header", "footer")
BLOCKS = ("p", "div", "br", "tr", "li", "h1", "h2", "h3", "h4", "h5", "h6")
PAGE_CHARS = 60_000
PAGE_BREAK = "\x0c"


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def read_text(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(path, stem, modified, text): one row for each file, bytes that are no UTF-8 left out, Unix line ends."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.{txt,md}").load(path)
    raw = F.col("content").cast("string")
    text = F.when(F.is_valid_utf8(raw), raw).otherwise(F.replace(F.make_valid_utf8(raw), F.lit("\ufffd"), F.lit("")))
    return files.select("path", stem(F.col("path")).alias("stem"), F.col("modificationTime").alias("modified"), unix_lines(text).alias("text"))


def docx_text(data: bytes) -> str:
    """The paragraphs of a word-processor file, one a line."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(f"{w}t")) for p in root.iter(f"{w}p"))


def pdf_pages(data: bytes) -> list[str]:
    from pypdf import PdfReader

    return [p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages]


def file_text(name: str, data: bytes) -> tuple[str | None, str | None]:
    """(text, problem) of a file by its suffix; the pages of a PDF file are parted by form feeds."""
    suffix = name[name.rfind(".") :].lower() if "." in name else ""
    if suffix in (".txt", ".md"):
        return data.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n"), None
    if suffix == ".docx":
        try:
            return docx_text(data), None
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
            return None, "this is no readable word-processor file"
    if suffix == ".pdf":
        try:
            return PAGE_BREAK.join(x.replace(PAGE_BREAK, "\n") for x in pdf_pages(data)), None
        except ImportError:
            return None, "reading PDF files needs the pypdf library"
        except Exception as e:  # whatever a broken file makes the library raise
            return None, f"this is no readable PDF file ({type(e).__name__})"
    return None, f"files of type {suffix or '(none)'} are not supported"


def _files(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        got = [file_text(p, bytes(c)) for p, c in zip(frame["path"], frame["content"], strict=True)]
        yield pd.DataFrame({"path": frame["path"], "text": [t for t, _ in got], "problem": [x for _, x in got]})


def without_page_furniture(texts: DataFrame) -> DataFrame:
    """(path, text) of paged texts without running heads and feet, the pages joined."""
    pages = texts.select("path", F.posexplode(F.split("text", PAGE_BREAK)).alias("page_no", "page"))
    lines = pages.select("path", "page_no", F.posexplode(F.split("page", "\n")).alias("line_no", "line"))
    kept = furniture.positional_furniture(lines, "path")
    own = kept.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("page_no", "line_no", "line"))).alias("l"))  # lines of one file
    return texts.select("path").join(own, "path", "left").select("path", F.coalesce(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("")).alias("text"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, problem) of files of all supported types; unsupported or broken ones have a problem and no text."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInPandas(_files, "path string, text string, problem string")
    paged = F.lower("path").endswith(".pdf") & F.col("text").isNotNull()
    clean = without_page_furniture(read.where(paged)).withColumn("problem", F.lit(None).cast("string"))
    return read.where(~paged).unionByName(clean)


def statute_texts(files: DataFrame, least: int = 5000) -> DataFrame:
    """Files (path, text, problem) that hold enough text to be an act."""
    return files.where(F.col("problem").isNull() & (F.length("text") >= least))


def listed_exhibits(hits: DataFrame, kinds: tuple[str, ...] = ("EX-10",)) -> DataFrame:
    """hits (url, file_type, ...) of a filings search: exhibits of the kinds, each url once."""
    kind = F.exists(F.array(*map(F.lit, kinds)), lambda k: F.startswith(F.upper("file_type"), k))
    return hits.where(F.coalesce(kind, F.lit(False))).dropDuplicates(["url"])


def settings(path: str, environment: dict[str, str]) -> tuple[dict[str, str], list[str]]:
    """(values, conflicts) of a file of NAME=value lines; what the environment has already wins, and differences are named."""
    values: dict[str, str] = {}
    with open(path, encoding="utf-8") as f:
        for line in map(str.strip, f):
            if line and not line.startswith("#") and "=" in line:
                name, _, value = line.partition("=")
                values[name.strip()] = value.strip().strip("\"'")
    conflicts = sorted(k for k, v in values.items() if k in environment and environment[k] != v)
    return values | {k: environment[k] for k in values if k in environment}, conflicts


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def load_mapping(path: str) -> dict:
    """A JSON or YAML file."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise ImportError("reading YAML files needs the yaml library; JSON files need none") from e
    return yaml.safe_load(text)


def load_rules(path: str) -> tuple[str, list[dict]]:
    """(type, validated rules) of a rule file."""
    spec = load_mapping(path)
    return spec["doc_type"], rule_engine.validate(spec["rules"])


def load_profile(path: str) -> dict:
    """A type profile: all keys there, and its slug the file's name."""
    profile = load_mapping(path)
    missing = {"slug", "label", "corpus", "taxonomy", "severity_scale"} - set(profile)
    name = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    if missing or profile["slug"] != name:
        raise ValueError(f"profile {name}: missing {sorted(missing)}" if missing else f"profile {name} has the slug {profile['slug']}")
    return profile


def load_norms(spark: SparkSession, path: str) -> dict:
    """field -> percentiles; nothing if there is no file."""
    try:
        rows = spark.read.option("wholetext", True).text(path).collect()  # one small file
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return {}
        raise
    return json.loads(rows[0][0]) if rows else {}


def rules_table(spark: SparkSession, rules: dict[str, list[dict]] = RULES) -> DataFrame:
    """A row for each rule: type, id, category, basis, severity, scope, fields and the condition as JSON."""
    rows = [(t, i, r["id"], r["category"], r["basis"], r["severity"], r.get("scope", "clause"), ",".join(rule_engine.required_fields(r)), json.dumps(r["when"])) for t, own in rules.items() for i, r in enumerate(own)]
    return spark.createDataFrame(rows, "doc_type string, rule_order int, rule_id string, category string, basis string, severity string, scope string, fields string, condition string")


def lint_report(spark: SparkSession, rules: dict[str, list[dict]] = RULES) -> DataFrame:
    """(kind, n, rules): what looks wrong in a rulebook but loads, by the kind of fault, the rules as a sorted array of "type id"."""
    found = rule_engine.lint(rules, gates.GATES, {t: p["taxonomy"] for t, p in PROFILES.items()})
    rows = spark.createDataFrame(found, "doc_type string, rule_id string, kind string")
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set(F.concat_ws(" ", "doc_type", "rule_id"))).alias("rules"))


def required_parameters(spark: SparkSession, rules: dict[str, list[dict]] = RULES) -> DataFrame:
    return spark.createDataFrame([(t, f) for t, own in rules.items() for f in rule_engine.required_params(own)], "doc_type string, field string")


def corpus_alias(spark: SparkSession) -> DataFrame:
    """(corpus_id, stem) of the profiles' corpus files."""
    rows = {(c["id"], c["path"].rsplit("/", 1)[-1].rsplit(".", 1)[0]) for p in PROFILES.values() for c in p["corpus"]}
    return spark.createDataFrame(sorted(rows), "corpus_id string, stem string")


# -- web pages -----------------------------------------------------------------------------------


def _without(html: Column, tags: tuple[str, ...]) -> Column:
    for tag in tags:
        html = F.regexp_replace(html, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    return html


def _entities(x: Column) -> Column:
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(sign))
    return x


def html_text(html: Column, blocks: bool = True) -> Column:
    """The text of a page: a line for each block without scripts, styles and tables; or, without
    blocks, one line without page chrome either."""
    own = _without(F.coalesce(html, F.lit("")), DROPPED if blocks else CHROME)
    if blocks:
        own = F.regexp_replace(own, r"(?i)</?(%s)\b[^>]*>" % "|".join(BLOCKS), "\n")
    own = _entities(F.regexp_replace(own, r"(?s)<[^>]*>", " "))
    if not blocks:
        return F.trim(F.regexp_replace(own, r"\s+", " "))
    return F.btrim(F.regexp_replace(F.regexp_replace(F.regexp_replace(own, r"[ \t\r]+", " "), r" ?\n ?", "\n"), r"\n{2,}", "\n"), F.lit(" \n"))


def captured(html: Column) -> Column:
    """What a client sends of a page."""
    return F.left(html_text(html, blocks=False), F.lit(PAGE_CHARS))


LEGAL_WORDS = ("agreement", "terms", "liability", "indemnif", "governing law", "warranty", "termination", "arbitration")


def contract_like(url: Column, html: Column, text: Column, legal=LEGAL_WORDS) -> Column:
    """Two of three: a control to accept, a long text with three legal words, a path of that name."""
    accept = html.rlike(r"(?i)<(?:button|input|a)\b[^>]*>?[^<]*\b(?:accept|agree)\b")
    low = F.lower(text)
    n = F.size(F.filter(F.array(*map(F.lit, legal)), lambda w: F.contains(low, w)))
    long = (F.size(F.split(text, " ")) > 2000) & (n >= 3)
    path = F.lower(url).rlike(r"/(?:terms|tos|legal|agreement|policy|policies|conditions)")
    return (accept.cast("int") + long.cast("int") + path.cast("int")) >= 2


def repaired_lines(text: Column) -> Column:
    """Lines joined unless the one before is empty or ends a sentence and this one starts afresh."""
    first = F.struct(F.lit("").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, raw: Column) -> Column:
        line, open_, done = F.trim(raw), acc["open"], acc["done"]
        flush = F.when(open_ == "", done).when(done == "", open_).otherwise(F.concat(done, F.lit("\n"), open_))
        fresh = open_.rlike(r"[.;:!?]\s*$") & line.rlike(r"^(?:[A-Z0-9(\"'])")
        return (
            F.when(line == "", F.struct(flush.alias("done"), F.lit("").alias("open")))
            .when((open_ == "") | fresh, F.struct(flush.alias("done"), line.alias("open")))
            .when(open_.rlike(r"[a-z]-$") & line.rlike("^[a-z]"), F.struct(done.alias("done"), F.concat(F.regexp_replace(open_, "-$", ""), line).alias("open")))
            .otherwise(F.struct(done.alias("done"), F.concat(open_, F.lit(" "), line).alias("open")))
        )

    end = lambda acc: F.when(acc["open"] == "", acc["done"]).when(acc["done"] == "", acc["open"]).otherwise(F.concat(acc["done"], F.lit("\n"), acc["open"]))
    return F.aggregate(F.split(text, "\n"), first, step, end)


SIGNALS = ("agreement", "party", "shall", "hereby")


def is_agreement(text: Column, signals=SIGNALS, low: int = 4000, high: int = 120_000) -> Column:
    """A fit length and three of the signals in the first 6,000 characters."""
    head = F.lower(F.left(text, F.lit(6000)))
    return F.length(text).between(low, high) & (F.size(F.filter(F.array(*map(F.lit, signals)), lambda s: F.contains(head, s))) >= 3)


def is_the_act(text: Column, sections: tuple[int, ...] = (11, 15, 17), least: int = 35_000) -> Column:
    out = F.length(text) >= least
    for s in sections:
        out = out & text.rlike(rf"(?m)^\s*{s}\.\s")
    return out


def private_rows(rows: DataFrame, known: str, deny: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """Rows whose doc_id is not shaped like the corpus's, that hold a denied word, or that are longer than most."""
    denied = F.exists(F.array(*map(F.lit, deny)), lambda w: F.contains(F.lower("text"), w)) if deny else F.lit(False)
    long = F.length("text") > most if most else F.lit(False)
    return rows.where(~F.coalesce(F.col("doc_id").cast("string").rlike(known), F.lit(False)) | F.coalesce(denied | long, F.lit(False)))


# -- versions and results ------------------------------------------------------------------------


#: Folders that a version's documents are dealt into, so that a folder holds many documents.
VERSION_BUCKETS = 64


def _bucket() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(VERSION_BUCKETS)).cast("int")


def save_version(clauses: DataFrame, path: str, version: str) -> None:
    """Clauses (doc_id, idx, heading, text, ...) under their version; saving a document's version again replaces it.

    Folders are by version and a hash of the document; those of the documents saved are written anew
    together with the other documents that they hold.
    """
    spark = clauses.sparkSession
    new = clauses.withColumn("saved_at", F.current_timestamp()).withColumn("version", F.lit(version)).withColumn("bucket", _bucket())
    scratch = Scratch(spark, "versions")
    new = scratch.table(new, "new")
    try:
        had = spark.read.schema(new.schema).parquet(path).where(F.col("version") == version)
        others = had.join(new.select("bucket").distinct(), "bucket", "left_semi").join(new.select("doc_id").distinct(), "doc_id", "left_anti")
        new = scratch.table(new.unionByName(others.select(*new.columns)), "merged")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new.repartition("version", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version", "bucket").parquet(path)


def load_version(spark: SparkSession, path: str, version: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("version").cast("string") == version).drop("bucket")


def list_versions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("doc_id", "version").agg(F.max("saved_at").alias("saved_at"), F.count(F.lit(1)).alias("clauses"))


def record_sample(found: DataFrame, summary: DataFrame, path: str, name: str) -> None:
    """A sample audit as JSON lines below a folder, and its line in the index; refused unless it is complete."""
    row = summary.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("problem").isNotNull()).alias("bad"), F.sum("unread").alias("unread"), F.sum("flagged").alias("flagged"), F.sum("high").alias("high")).first()
    if not row["n"] or row["bad"] or row["unread"]:
        raise ValueError(f"sample {name} is not complete: {row['n']} documents, {row['bad']} with a problem, {row['unread']} unread clauses")
    write_jsonl(found, f"{path}/{name}/findings")
    write_jsonl(summary, f"{path}/{name}/summary")
    line = found.sparkSession.createDataFrame([(name, row["n"], row["flagged"], row["high"])], "name string, documents long, flagged long, high long")
    line.write.mode("append").json(f"{path}/index")


def suggest_pending(clauses: DataFrame, path: str, suggest, schema: str, key: str = "clause_id") -> DataFrame:
    """Suggestions for the clauses that have none yet are appended below a folder; all that are there are returned."""
    spark = clauses.sparkSession
    try:
        done = spark.read.schema(schema).json(path)
        left = Scratch(spark, "pending").table(pending(clauses, done, key), "left")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        left = clauses
    write_jsonl(suggest(left), path, "append")
    return spark.read.schema(schema).json(path)


def pending(rows: DataFrame, done: DataFrame, key: str = "clause_id") -> DataFrame:
    """Rows that are not done yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def merged_results(old: DataFrame, new: DataFrame, key: str = "metric") -> DataFrame:
    """Rows of both, the new ones over old ones of the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def findings_json(findings: DataFrame) -> DataFrame:
    """(doc_id, json) for download, a row for each finding."""
    return findings.select("doc_id", F.to_json(F.struct(*findings.columns)).alias("json"))
