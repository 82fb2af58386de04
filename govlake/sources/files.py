"""Sources and sinks: file trees, ledgers, run artifacts, packs, manifests and exports."""

from __future__ import annotations

import os
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from govlake.functions.rules import any_glob

VENDORED = ("**/node_modules/**", "**/vendor/**", "**/.git/**", "**/dist/**", "**/build/**", "**/coverage/**")
BINARY = ("png", "jpg", "gif", "ico", "pdf", "zip", "gz", "jar", "so", "dll", "exe", "wasm", "woff", "mp3", "mp4")


def scan_files(spark: SparkSession, root: str, include: list[str] = (), exclude: list[str] = (), max_kb: int = 512) -> DataFrame:
    """(path, ext, size, content) of the text files under a root: no vendored folders, no binaries, nothing above the size cap, which is
    checked before a file is opened, or with a NUL in its first 8 KiB. Empty files hold nothing and are left out, as by Spark's reader."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= max_kb * 1024)
    base = root.rstrip("/").split("://")[-1] + "/"
    within = lambda path: F.regexp_replace(F.substring_index(path, base, -1), "^/+", "")
    ext_of = lambda path: F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))

    def kept(path: Column) -> Column:
        keep = ~any_glob(path, [*VENDORED, *exclude]) & ~ext_of(path).isin(*BINARY)
        return keep & any_glob(path, include) if include else keep

    # What the list of files tells is settled before tasks are made: no task opens a file that goes by its place or size. There, paths are URLs.
    listed = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    files = files.where((F.col("_metadata.file_size") <= max_kb * 1024) & kept(within(listed)))
    path = within(F.col("path"))
    text = ~F.hex(F.substring("content", 1, 8192)).rlike("^(?:..)*?00")
    return files.where(kept(path) & text).select(path.alias("path"), ext_of(path).alias("ext"), F.col("length").alias("size"), F.decode("content", "UTF-8").alias("content"))


def write_files(rows: DataFrame, root: str) -> None:
    """Each row (folder, value) as a text file of its own, with a line end, in that folder under root, which is new.

    Under file:, which all executors must share, tasks write the files themselves, under names that a repeated task writes again; Spark's writer starts programs for each file there, to set its
    rights. Elsewhere it is Spark's writer, folder by folder.
    """
    if not root.startswith("file:"):
        for folder in sorted(r.folder for r in rows.select("folder").distinct().collect()):
            rows.where(F.col("folder") == folder).select("value").write.option("maxRecordsPerFile", 1).text(f"{root}/{folder}")
        return
    place = re.sub("^file:/+", "/", root)

    def write(batches):
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for folder, value in zip(batch["folder"].to_pylist(), batch["value"].to_pylist(), strict=True):
                os.makedirs(f"{place}/{folder}", exist_ok=True)
                with open(f"{place}/{folder}/part-{part:05d}-{n:09d}.txt", "wb") as out:
                    out.write((value or "").encode() + b"\n")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    rows.select("folder", "value").mapInArrow(write, "n long").agg(F.sum("n")).collect()


def append_ledger(df: DataFrame, path: str) -> None:
    """Adds rows to a ledger of JSON lines."""
    df.write.mode("append").json(path)


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The ledger's rows; lines that aren't JSON of the schema are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_artifact(df: DataFrame, path: str) -> None:
    """Adds a run's rows to a store with one folder per run_id."""
    df.write.mode("append").partitionBy("run_id").parquet(path)


def latest_run(journal: DataFrame, results: DataFrame, project: str) -> DataFrame:
    """(project, run_id, ts): the newest run whose last phase is done and whose result exists."""
    done = journal.where("phase = 6 and event = 'done'").join(results.select("run_id").distinct(), "run_id", "left_semi")
    nth = F.row_number().over(W.partitionBy(project).orderBy(F.desc("ts"), F.desc("run_id")))
    return done.withColumn("nth", nth).where("nth = 1").select(project, "run_id", "ts")


PACK = "id string, name string, kind string, currency string, authorities array<struct<name:string,domain:string>>, instruments array<struct<id:string,title:string,in_force:boolean>>, facet_hints map<string,string>, seed_obligations array<struct<id:string,provision:string,text:string>>"


def load_packs(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """packs, authorities, instruments, hints and seeds from JSON files, one pack each."""
    packs = spark.read.schema(PACK).option("multiLine", "true").json(folder)
    each = lambda c: packs.select(F.col("id").alias("pack"), F.explode(c).alias("x")).select("pack", "x.*")
    hints = packs.select(F.col("id").alias("pack"), F.explode("facet_hints").alias("facet", "hint"))
    return {"packs": packs.select("id", "name", "kind", "currency"), "authorities": each("authorities"), "instruments": each("instruments"), "hints": hints, "seeds": each("seed_obligations")}


def load_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(category, special, term, ord) of a lexicon file {categories: [{name, special, terms}]}."""
    raw = spark.read.schema("categories array<struct<name:string,special:boolean,terms:array<string>>>").option("multiLine", "true").json(path)
    cats = raw.select(F.posexplode("categories").alias("i", "c"))
    terms = cats.select("i", F.col("c.name").alias("category"), F.col("c.special").alias("special"), F.posexplode("c.terms").alias("j", "term"))
    return terms.select("category", "special", "term", (F.col("i") * 1000 + F.col("j")).alias("ord"))


def changed_since(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Paths of current that are new or whose text has another hash."""
    p = previous.select("path", F.sha2("content", 256).alias("h"))
    c = current.select("path", F.sha2("content", 256).alias("now"))
    return c.join(p, "path", "left").where(~F.col("now").eqNullSafe(F.col("h"))).select("path")


def export_manifest(files: DataFrame) -> DataFrame:
    """(path, sha256, bytes)."""
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("bytes"))


def export_findings(found: DataFrame) -> DataFrame:
    """(rule_id, level, uri, line, snippet_hash, first): code-scanning rows; info and low findings and artifacts stay out; first marks the row that
    defines its rule, that of the smallest place. line is the finding's own."""
    level = F.when(F.col("severity").isin("critical", "high"), "error").when(F.col("severity") == "medium", "warning").otherwise("note")
    rows = found.where(~F.col("severity").isin("info", "low")).select(F.concat(F.lit("evidence/"), "rule").alias("rule_id"), level.alias("level"), F.col("path").alias("uri"), "line", "snippet_hash")
    place = F.struct("uri", "line", "snippet_hash")
    heads = rows.groupBy("rule_id").agg(F.min(place).alias("head"))  # one row per rule, of which there are few
    return rows.join(heads, "rule_id").withColumn("first", place == F.col("head")).drop("head")


def _level(severity: Column) -> Column:
    return F.when(severity.isin("critical", "high"), "error").when(severity == "medium", "warning").otherwise("note")


RESULT = "rule_id string, level string, uri string, line long, fingerprint string, message string, properties map<string,string>"


def code_scanning(gaps: DataFrame, adversary: DataFrame, found: DataFrame) -> DataFrame:
    """RESULT rows with run_id of gaps (run_id, id, title, obligation, severity, anchor, fix), adversary findings (run_id, id, title, category, severity, status, location) and
    evidence (run_id, rule, kind, severity, path, line, snippet_hash).

    Rules are gap/OBLIGATION, or gap/ID without one, security/CATEGORY and evidence/RULE. An anchor PATH:LINE is split, line 1 without a number, uri . without an anchor. Of evidence, info and
    low findings and artifacts stay out.
    """
    def place(anchor: Column) -> list[Column]:
        line = F.regexp_extract(anchor, r":(\d{1,9})(?:-\d+)?$", 1)
        uri = F.regexp_replace(anchor, r":\d{1,9}(?:-\d+)?$", "")
        return [F.coalesce(F.nullif(uri, F.lit("")), F.lit(".")).alias("uri"), F.coalesce(F.nullif(line, F.lit("")).cast("long"), F.lit(1).cast("long")).alias("line")]

    def told(**of: Column) -> Column:
        return F.map_filter(F.create_map(*[x for k, v in of.items() for x in (F.lit(k), v.cast("string"))]), lambda k, v: v.isNotNull()).alias("properties")

    col = F.col
    own = gaps.select("run_id", F.concat(F.lit("gap/"), F.coalesce("obligation", col("id").cast("string"))).alias("rule_id"), _level(col("severity")).alias("level"), *place(col("anchor")), col("id").cast("string").alias("fingerprint"), F.concat_ws("\n\n", "title", "fix").alias("message"), told(severity=col("severity"), obligation=col("obligation")))
    doubt = F.when(col("status") == "unconfirmed", "(Unconfirmed: no local evidence anchor.)")
    adv = adversary.select("run_id", F.concat(F.lit("security/"), "category").alias("rule_id"), _level(col("severity")).alias("level"), *place(col("location")), col("id").cast("string").alias("fingerprint"), F.concat_ws("\n\n", "title", doubt).alias("message"), told(severity=col("severity"), status=col("status")))
    kept = found.where(~col("severity").isin("info", "low") & ~F.coalesce(col("kind"), F.lit("")).startswith("artifact_"))
    evidence = kept.select("run_id", F.concat(F.lit("evidence/"), "rule").alias("rule_id"), _level(col("severity")).alias("level"), col("path").alias("uri"), col("line").cast("long").alias("line"), col("snippet_hash").alias("fingerprint"), col("rule").alias("message"), told(severity=col("severity"), kind=col("kind")))
    return own.unionByName(adv).unionByName(evidence)


def write_code_scanning(results: DataFrame, folder: str) -> None:
    """A folder run_id=RUN per run of JSON lines: a nested document {rule} for each different rule, the one of the smallest message telling what it is, and one {result} for each row. No run has to
    fit in a task; the lines of a run joined give its document."""
    place = F.struct(F.struct(F.col("uri").alias("artifact"), F.struct(F.col("line").alias("start")).alias("region")).alias("physical"))
    result = F.struct(F.lit(None).cast("struct<id:string,name:string,level:string>").alias("rule"), F.struct(F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"), F.struct(F.col("fingerprint").alias("id")).alias("fingerprints"), "properties").alias("result"))
    rules = results.groupBy("run_id", "rule_id").agg(F.min("message").alias("name"), F.min("level").alias("level"))
    rule = F.struct(F.struct(F.col("rule_id").alias("id"), F.left("name", F.lit(80)).alias("name"), "level").alias("rule"))
    lines = results.select("run_id", F.to_json(result).alias("value")).unionByName(rules.select("run_id", F.to_json(rule).alias("value")))
    lines.write.partitionBy("run_id").text(folder)


DOCUMENT = "rule struct<id:string,name:string,level:string>, result struct<ruleId:string,level:string,message:struct<text:string>,locations:array<struct<physical:struct<artifact:string,region:struct<start:long>>>>,fingerprints:struct<id:string>,properties:map<string,string>>"


def read_code_scanning(spark: SparkSession, folder: str) -> DataFrame:
    """(rule, result, run_id) of what write_code_scanning wrote, one of rule and result null."""
    return spark.read.schema(DOCUMENT + ", run_id string").json(folder)


def purl(ecosystem: Column, name: Column, version: Column) -> Column:
    return F.concat(F.lit("pkg:"), F.lower(ecosystem), F.lit("/"), name, F.lit("@"), version)


def component_inventory(manifests: DataFrame) -> DataFrame:
    """(path, ecosystem, name, version, purl) from package.json, requirements.txt, pyproject.toml and go.mod; * without a version."""
    path, text = F.col("path"), F.col("content")
    bare = lambda v: F.when(F.coalesce(F.regexp_replace(v, "[\\^~>=<! ]", ""), F.lit("")) == "", "*").otherwise(F.regexp_replace(v, "[\\^~>=<! ]", ""))
    parsed = F.from_json(text, "dependencies map<string,string>, devDependencies map<string,string>")
    empty = F.create_map().cast("map<string,string>")
    own, dev = F.coalesce(parsed["dependencies"], empty), F.coalesce(parsed["devDependencies"], empty)
    both = F.array_union(F.map_entries(own), F.filter(F.map_entries(dev), lambda e: ~F.map_contains_key(own, e.key)))
    npm = manifests.where(path.endswith("package.json")).select("path", F.lit("npm").alias("ecosystem"), F.explode(both).alias("d")).select("path", "ecosystem", F.col("d.key").alias("name"), bare(F.col("d.value")).alias("version"))
    line = lambda suffix, eco, shape: manifests.where(path.endswith(suffix)).select("path", F.lit(eco).alias("ecosystem"), F.explode(F.split(text, "\n")).alias("l")).select("path", "ecosystem", F.regexp_extract("l", shape, 1).alias("name"), bare(F.regexp_extract("l", shape, 2)).alias("version")).where("name <> ''")
    py = line("requirements.txt", "pypi", r"^([A-Za-z0-9_.-]+)(?:\[[^\]]*\])?\s*(?:[=<>~!]=?\s*([0-9][^,;\s]*))?")
    toml = line("pyproject.toml", "pypi", r'^\s*"([A-Za-z0-9_.-]+)\s*(?:[=<>~!]=?\s*([0-9][^",;\s]*))?[^"]*",?\s*$')
    go = line("go.mod", "go", r"^\s*(?:require\s+)?([a-z0-9.-]+\.[a-z]+/[^\s]+)\s+v([0-9][^\s]*)")
    out = npm.unionByName(py).unionByName(toml).unionByName(go)
    return out.withColumn("purl", purl(F.col("ecosystem"), F.col("name"), F.col("version")))
