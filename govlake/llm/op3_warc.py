"""WARC records and a Merkle fixity audit of two replicas of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from govlake.functions.blocks import Blocks
from govlake.llm.store import saved

FAN = 16
PER_FILE = 1000
_END = "\r\n\r\n"
_HEAD = b"WARC/1.0\r\n"


def _octets(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit("")))


def record_text(key: Column, url: Column, body: Column) -> Column:
    """A response record of WARC/1.0 without the two line ends behind it."""
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(key.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        _octets(body).cast("string"),
        F.lit(_END),
    )
    return F.concat(head, F.coalesce(body, F.lit("")))


def warc_records(pages: DataFrame, key_col: str = "page_id", url_col: str = "url", body_col: str = "html", per_file: int = PER_FILE) -> DataFrame:
    """(file, key, record): one record per page, in files of keys that lie in the same range of per_file.

    Null urls and bodies are empty; a null key is in the file of key 0 with an empty id.
    """
    number = F.floor(F.coalesce(F.col(key_col), F.lit(0)) / per_file).cast("string")
    name = F.concat(F.lit("pages-"), F.lpad(number, 8, "0"), F.lit(".warc"))
    return pages.select(name.alias("file"), F.col(key_col).cast("long").alias("key"), record_text(F.col(key_col), F.col(url_col), F.col(body_col)).alias("record"))


def write_warc(records: DataFrame, folder: str) -> None:
    """One WARC file per part under folder/file=NAME, records in the order of their keys."""
    rows = records.repartition("file").sortWithinPartitions("file", "key").select("file", F.col("record").alias("value"))
    rows.write.partitionBy("file").option("lineSep", _END).text(folder)


def _cut(content: bytes):
    """(offset, record, whether it is whole) of a WARC file's records. One whose head or length is damaged reaches to the next head."""
    at = 0
    while at < len(content):
        head, end = content.find(_END.encode(), at), -1
        if content.startswith(_HEAD, at) and head >= 0:
            sizes = [x.split(b":", 1)[1].strip() for x in content[at:head].split(b"\r\n") if x.lower().startswith(b"content-length:")]
            end = head + 4 + int(sizes[0]) if len(sizes) == 1 and sizes[0].isdigit() else -1
        whole = 0 <= end <= len(content) and (content.startswith(_END.encode(), end) or not content[end:].strip(b"\r\n"))
        if not whole:
            following = content.find(_HEAD, at + 1)
            end = len(content) if following < 0 else following
        yield at, content[at:end] if whole else content[at:end].removesuffix(_END.encode()), whole
        at = end
        while content[at : at + 1] in (b"\r", b"\n"):
            at += 1


def read_warc(spark: SparkSession, folder: str, names: str = "*.{warc,warc.gz,txt}") -> DataFrame:
    """(file, seq, offset, length, record, raw, key, status) of WARC files, those in folders file=NAME that write_warc wrote and others, packed by gzip or not. raw holds a record's bytes as they are, without the line ends
    behind them, and record what they are as UTF-8, with U+FFFD for bytes that aren't; `audit` compares raw.

    A file is read by one task, and gzip members are unpacked. Records are cut by their Content-Length; one whose head, length or end is damaged has status unreadable and reaches to the next
    WARC/1.0, where reading goes on; others are whole. What can't be unpacked of a gzip file is one unreadable record. key is the number in a record id
    urn:page:NUMBER, for other ids their CRC-32, null without one. offset is that in the unpacked file.
    """
    import re
    import zlib

    import pyarrow as pa

    def unpacked(content: bytes) -> tuple[bytes, bytes]:
        """What a file holds, and what of it can't be unpacked."""
        if not content.startswith(b"\x1f\x8b"):
            return content, b""
        parts = []
        while content:
            machine = zlib.decompressobj(31)
            try:
                parts.append(machine.decompress(content))
            except zlib.error:
                return b"".join(parts), content
            if not machine.eof:
                return b"".join(parts), b""
            content = machine.unused_data.lstrip(b"\0")
        return b"".join(parts), b""

    def run(batches):
        for batch in batches:
            for path, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = path.rpartition("file=")[2].partition("/")[0] if "file=" in path else path.rpartition("/")[2]
                content, broken = unpacked(packed)
                rows = [*_cut(content), *([(len(content), broken, False)] if broken else [])]
                for seq, (at, record, whole) in enumerate(rows):
                    found = re.search(rb"(?im)^WARC-Record-ID:\s*<?([^>\r\n]*)", record.partition(_END.encode())[0])
                    number = re.fullmatch(rb"urn:page:(-?\d{1,18})", found[1]) if found else None
                    key = int(number[1]) if number else zlib.crc32(found[1]) if found and found[1] else None
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([seq]), pa.array([at]), pa.array([len(record)]), pa.array([record.decode(errors="replace")]), pa.array([record], pa.binary()), pa.array([key], pa.int64()), pa.array(["whole" if whole else "unreadable"])], ["file", "seq", "offset", "length", "record", "raw", "key", "status"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(folder)
    return files.select("path", "content").mapInArrow(run, "file string, seq long, offset long, length long, record string, raw binary, key long, status string")


def leaves(records: DataFrame) -> DataFrame:
    """(file, seq, key, offset, length, hash): SHA-256 of each record's bytes and its place in its file. Records of equal keys stand in the order of their hashes; a file
    of any length is numbered by blocks."""
    record = "raw" if "raw" in records.columns else "record"
    hashed = records.select("file", "key", F.octet_length(record).cast("long").alias("length"), F.sha2(F.col(record).cast("binary"), 256).alias("hash"))
    blocks = Blocks(hashed, ["file"], ["key", "hash"])
    own = F.sum(F.col("row.length") + len(_END)).over(blocks.run.rowsBetween(W.unboundedPreceding, -1))
    rows = blocks.rows.withColumns({"own": own, "nth": F.row_number().over(blocks.run)})
    sums = F.struct(F.sum(F.col("row.length") + len(_END)).alias("bytes"), F.count("*").alias("n"))
    rows = blocks.with_carry(rows, sums, lambda a, b: (a[0] + b[0], a[1] + b[1]))
    before = {c: F.coalesce(F.col(f"carry.{c}"), F.lit(0)) for c in ("bytes", "n")}
    return rows.select("row.file", (F.col("nth") - 1 + before["n"]).cast("long").alias("seq"), "row.key", (F.coalesce("own", F.lit(0)) + before["bytes"]).cast("long").alias("offset"), "row.length", "row.hash")


def _place(key: str = "key") -> Column:
    """Where a record hangs in the tree: its key, whatever stands before it; a null key is at 0."""
    return F.coalesce(F.col(key), F.lit(0))


def _up(idx: Column) -> Column:
    """The place of the node above: floor(idx / FAN) without a detour by doubles."""
    return F.shiftright(idx, FAN.bit_length() - 1)


def parents(nodes: DataFrame, keys: list, *order: str) -> DataFrame:
    """Nodes over those with equal keys: hash of the children's places, lengths and hashes in order. Offsets aren't hashed, so a record that is lost changes no node beside its own."""
    part = F.concat_ws(":", *[F.col(x).cast("string") for x in order], (F.col("end") - F.col("start")).cast("string"), "hash")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, part.alias("p")))), lambda x: x.p), "|")
    return nodes.groupBy(*keys).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sha2(joined, 256).alias("hash"))


def _by_key(level: DataFrame) -> DataFrame:
    """One node for all records of a key, however many: a hash of their number and of sums of their hashes' parts, whatever their order."""
    parts = [F.sum(F.conv(F.substring("hash", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    joined = F.sha2(F.concat_ws(":", F.count("*").cast("string"), *parts), 256)
    return level.groupBy("bucket", "file", "idx", "empty").agg(F.min("start").alias("start"), F.max("end").alias("end"), joined.alias("hash"))


def tree(rows: DataFrame, depth: int, digits: int) -> list[DataFrame]:
    """Levels of nodes (bucket, file, idx, start, end, hash), from those over records to the root of all files.

    The first level joins the records of a file whose keys lie in the same range of FAN, each further one FAN
    neighbours and is written once, so each node covers an unbroken range of keys, the same in every replica, and tells the range of offsets that they fill. Above
    them stand the files, then levels of prefixes of `digits`, digits - 1, ... 0 hexadecimal digits of the hash of a file's name, each node over about FAN others.
    """
    none, zero = F.lit("").alias("file"), F.lit(0).cast("long").alias("idx")
    bucket = F.substring(F.sha2("file", 256), 1, digits) if digits else F.lit("")
    level = _by_key(rows.select(bucket.alias("bucket"), "file", _place().alias("idx"), F.col("key").isNull().alias("empty"), F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("end"), "hash"))
    levels = []
    for k in range(depth):
        up = level.withColumn("up", _up(F.col("idx")))
        level = saved(parents(up, ["bucket", "file", "up"], *(["idx", "empty"] if k == 0 else ["idx"])).withColumnRenamed("up", "idx"), "level")
        levels.append(level)
    levels.append(saved(parents(level, ["bucket", "file"], "idx").select("bucket", "file", zero, "start", "end", "hash"), "level"))
    levels.append(saved(parents(levels[-1], ["bucket"], "file").select("bucket", none, zero, "start", "end", "hash"), "level"))
    for n in range(digits - 1, -1, -1):
        shorter = F.substring("bucket", 1, n) if n else F.lit("")
        level = levels[-1].withColumn("shorter", shorter)
        levels.append(saved(parents(level, ["shorter"], "bucket").select(F.col("shorter").alias("bucket"), none, zero, "start", "end", "hash"), "level"))
    return levels


def _record_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Records of two sides that have no equal record of their key on the other: (file, seq, key, offset, length, hash_a, hash_b)."""
    same = ["file", "place", "empty", "hash", "nth"]
    sides = []
    for x in (a, b):
        nth = F.row_number().over(W.partitionBy("file", "key", "hash").orderBy("seq"))
        sides.append(x.withColumns({"place": _place(), "empty": F.col("key").isNull(), "nth": nth}))
    mine = [x.join(y.select(*same), same, "left_anti") for x, y in (sides, sides[::-1])]
    pair = F.row_number().over(W.partitionBy("file", "key").orderBy("seq"))
    mine = [x.select("file", "place", "empty", pair.alias("nth"), F.struct("seq", "key", "offset", "length").alias(f"at_{n}"), F.col("hash").alias(f"hash_{n}")) for x, n in zip(mine, "ab", strict=True)]
    return mine[0].join(mine[1], ["file", "place", "empty", "nth"], "full").select("file", F.coalesce("at_a", "at_b").alias("at"), "hash_a", "hash_b").select("file", "at.*", "hash_a", "hash_b")


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """(file, seq, key, offset, length, hash_a, hash_b, status) of the records in which two replicas (file, key, record) differ.

    Both trees are compared from the roots down: a level is looked at only below nodes that differ above. Below the last
    ones records are matched by their keys; of those that repeat a key equal ones first, the others in their order.
    status is changed, missing (not in the second) or extra; an extra record's place is that in the second. The bytes of the column raw are compared, or those of record where there is no such column.
    Equal replicas, two empty ones included, give no row.
    """
    rows = [saved(leaves(x), "leaves") for x in (first, second)]
    most = max((x.groupBy("file").agg((F.max(_place()) - F.min(_place())).alias("n")).agg(F.max("n")).first()[0] or 0) for x in rows)
    depth = 1
    while FAN**depth <= most:
        depth += 1
    files, digits = max(x.select("file").distinct().count() for x in rows), 0
    while FAN ** (digits + 1) < files:
        digits += 1
    pairs = list(zip(*(tree(x, depth, digits) for x in rows), strict=True))
    key = ["bucket", "file", "idx"]
    wrong = None
    for level in range(len(pairs) - 1, -1, -1):
        a, b = pairs[level]
        if wrong is not None:
            n = digits - (level - depth - 1)  # of a prefix at this level
            shorter = F.substring("bucket", 1, n - 1) if n > 1 else F.lit("")
            above = [shorter, F.lit(""), F.lit(0)] if level > depth else [F.col("bucket"), F.lit(""), F.lit(0)] if level == depth else [F.col("bucket"), F.col("file"), F.lit(0) if level == depth - 1 else _up(F.col("idx"))]
            a, b = (x.withColumns(dict(zip(("b_", "f_", "i_"), above, strict=True))).join(wrong, ["b_", "f_", "i_"], "left_semi") for x in (a, b))
        both = a.select(*key, F.col("hash").alias("hash_a")).join(b.select(*key, F.col("hash").alias("hash_b")), key, "full")
        differ = saved(both.where(~F.col("hash_a").eqNullSafe(F.col("hash_b"))), "differ")  # else plans double with each level
        wrong = differ.select(F.col("bucket").alias("b_"), F.col("file").alias("f_"), F.col("idx").alias("i_"))
    below = wrong.select(F.col("f_").alias("file"), "i_")
    out = _record_differences(*(x.withColumn("i_", _up(_place())).join(below, ["file", "i_"], "left_semi").drop("i_") for x in rows))
    status = F.when(F.col("hash_b").isNull(), "missing").when(F.col("hash_a").isNull(), "extra").otherwise("changed")
    return out.withColumn("status", status)


def damaged(records: DataFrame, every: int = 97) -> DataFrame:
    """A replica in which one of `every` keys has lost the last character of its record to a '#', as bit rot would."""
    hurt = F.concat(F.expr("left(record, length(record) - 1)"), F.lit("#"))
    return records.withColumn("record", F.when(F.pmod(F.col("key"), F.lit(every)) == 5, hurt).otherwise(F.col("record")))


def shifted(records: DataFrame, every: int = 97) -> DataFrame:
    """A replica in which one of `every` keys has lost its record and one has a second one, so that all later offsets move. Null keys keep theirs."""
    k, record = F.pmod(F.col("key"), F.lit(every)), F.col("record")
    held = F.when(k == 11, F.array().cast("array<string>")).when(k == 23, F.array(record, F.concat(record, F.lit("+")))).otherwise(F.array(record))
    return records.withColumn("record", F.explode(held))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc_records(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return audit(records, shifted(damaged(records)))


SQL = f"""
WITH r AS (SELECT 'pages-' || lpad(CAST(page_id // {PER_FILE} AS VARCHAR), 8, '0') || '.warc' AS file, page_id AS key,
  'WARC/1.0' || e || 'WARC-Type: response' || e || 'WARC-Record-ID: <urn:page:' || page_id || '>' || e || 'WARC-Target-URI: ' || coalesce(url, '') || e ||
  'Content-Type: text/html' || e || 'Content-Length: ' || strlen(coalesce(html, '')) || e || e || coalesce(html, '') AS record
  FROM pages, (SELECT chr(13) || chr(10) AS e)),
h AS (SELECT file, key, CAST(strlen(record) AS BIGINT) AS length, sha256(record) AS hash_a,
  sha256(CASE WHEN key % 97 = 5 THEN left(record, length(record) - 1) || '#' ELSE record END) AS hash_b FROM r),
o AS (SELECT file, row_number() OVER w - 1 AS seq, key, CAST(coalesce(sum(length + 4) OVER (PARTITION BY file ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
  length, hash_a, hash_b FROM h WINDOW w AS (PARTITION BY file ORDER BY key)),
s AS (SELECT file, key, record, false AS more FROM r WHERE key % 97 <> 11 UNION ALL SELECT file, key, record || '+', true FROM r WHERE key % 97 = 23),
t AS (SELECT file, key, more, sha256(record) AS hash, CAST(strlen(record) AS BIGINT) AS length FROM s),
e AS (SELECT file, row_number() OVER w - 1 AS seq, key, CAST(coalesce(sum(length + 4) OVER (PARTITION BY file ORDER BY key, hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
  length, hash, more FROM t WINDOW w AS (PARTITION BY file ORDER BY key, hash))
SELECT file, seq, key, "offset", length, hash_a, hash_b, 'changed' AS status FROM o WHERE hash_a <> hash_b
UNION ALL SELECT file, seq, key, "offset", length, hash_a, NULL, 'missing' FROM o WHERE key % 97 = 11
UNION ALL SELECT file, seq, key, "offset", length, NULL, hash, 'extra' FROM e WHERE more
"""
