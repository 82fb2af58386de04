"""Redaction and release control: placeholders, pseudonyms, deny lists, gates and seals."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from govlake.functions.blocks import Blocks, numbered
from govlake.functions.folders import bounded, checkpointed
from govlake.functions.rules import DETECTORS, NEEDED, any_glob, detected, glob_regex, host_of, suppression
from govlake.functions.sql import register
from govlake.functions.tokens import looked_up, replaced, rewritten

_SECRETS = "|".join(p for _, kind, _, p in DETECTORS if kind == "secret")
#: Ports, sizes and durations that stay as they are. Fixed values.
PLAIN_NUMBERS = (1000, 1024, 3000, 3306, 3600, 5432, 6379, 8000, 8080, 8443, 27017, 65535, 86400, 604800, 2592000)
#: (reason, globs), first match wins. Fixed values.
DENIED = (
    ("env_file", (".env", ".env.*", "**/.env", "**/.env.*", "*.env")),
    ("private_key_or_cert", ("**/*.pem", "**/*.key", "**/*.p12", "**/*.pfx", "**/*.jks", "**/*.keystore", "**/*.crt", "**/*.cer", "**/*.der", "**/id_rsa*", "**/id_ed25519*")),
    ("secrets_directory", ("**/secrets/**", "**/credentials/**", "**/.aws/**", "**/.ssh/**", "**/.gnupg/**", "**/.npmrc", "**/.pypirc", "**/.netrc", "**/.git-credentials", "**/serviceAccount*.json", "**/gcp-*.json", "**/*credentials*.json")),
    ("lockfile_contents", ("**/package-lock.json", "**/yarn.lock", "**/pnpm-lock.yaml", "**/bun.lockb", "**/bun.lock", "**/poetry.lock", "**/Pipfile.lock", "**/Gemfile.lock", "**/composer.lock", "**/Cargo.lock", "**/go.sum", "**/gradle.lockfile")),
    ("notebook_output", ("**/*.ipynb",)),
    ("data_file", ("**/*.csv", "**/*.tsv", "**/*.parquet", "**/*.avro", "**/*.orc", "**/*.feather", "**/*.xls", "**/*.xlsx", "**/*.ods", "**/*.dta", "**/*.sav", "**/*.sqlite", "**/*.sqlite3", "**/*.db", "**/*.mdb", "**/*.rdb", "**/dump.sql", "**/*.dump", "**/*.bak", "**/*.ndjson", "**/*.jsonl", "**/fixtures/**", "**/__fixtures__/**", "**/testdata/**", "**/test-data/**", "**/seeds/**", "**/seed/**", "**/*.seed.*", "**/factories/**", "**/sample_data/**", "**/sample-data/**")),
    ("binary_or_vendored", ("**/*.zip", "**/*.tar", "**/*.tar.gz", "**/*.tgz", "**/*.gz", "**/*.7z", "**/*.rar", "**/*.png", "**/*.jpg", "**/*.jpeg", "**/*.gif", "**/*.webp", "**/*.ico", "**/*.pdf", "**/*.mp4", "**/*.mov", "**/*.mp3", "**/*.wav", "**/*.woff", "**/*.woff2", "**/*.ttf", "**/*.so", "**/*.dylib", "**/*.dll", "**/*.exe", "**/*.wasm", "**/*.class", "**/*.jar", "**/node_modules/**", "**/vendor/**", "**/.git/**", "**/dist/**", "**/build/**", "**/coverage/**", "**/*.min.js", "**/*.min.css", "**/*.map")),
)


def placeholder_of(value: Column) -> Column:
    """The typed placeholder of a literal: that of the first class it belongs to, else its length. The SQL function of that name, for columns outside of lambdas."""
    register(SparkSession.active())
    return F.call_function("placeholder_of", value)


def classify_literals(values: DataFrame, col: str) -> DataFrame:
    """(placeholder, dropped, n) of the values; nulls are none."""
    return values.where(F.col(col).isNotNull()).groupBy(placeholder_of(F.col(col)).alias("placeholder")).agg(F.count("*").alias("n")).select("placeholder", (F.col("placeholder") == "<dropped:secret>").alias("dropped"), "n")


def bucket_of(number: Column, threshold: int = 1000) -> Column:
    """<num:10^m..10^(m+1)> of a number at or above the threshold, else null. The exponent comes from digits, not from a float logarithm."""
    whole = F.abs(number).cast("bigint")
    digits = F.length(whole.cast("string"))
    low = F.rpad(F.lit("1"), digits, F.lit("0"))
    plain = F.abs(number).isin(*PLAIN_NUMBERS)
    return F.when((F.abs(number) >= threshold) & ~plain, F.concat(F.lit("<num:"), low, F.lit(".."), low, F.lit("0>")))


def bucket_numbers(df: DataFrame, col: str, threshold: int = 1000) -> DataFrame:
    """(bucket, n) of a column's numbers; null for those that stay, nulls included."""
    return df.groupBy(bucket_of(F.col(col), threshold).alias("bucket")).agg(F.count("*").alias("n"))


def pseudonym(kind: Column, real: Column, salt: str, attempt: Column, size: int) -> Column:
    """prefix_ and base-36 characters of a salted hash."""
    digest = F.sha2(F.concat_ws(":", F.lit(salt), kind, real, attempt.cast("string")), 256)
    return F.concat(kind, F.lit("_"), F.left(F.lower(F.conv(F.substring(digest, 1, 10), 16, 36)), F.lit(size)))


def mint_pseudonyms(symbols: DataFrame, salt: str, size: int = 8, attempts: int = 64) -> DataFrame:
    """(kind, real, pseudonym): unique names. Of symbols that want the same one the smallest has it; the others try the
    next attempt; those left after `attempts` of them take 32 hexadecimal digits of their hash, which no short name has.
    """
    left = symbols.select("kind", "real").distinct()
    done = None
    for attempt in range(attempts):
        want = left.withColumn("pseudonym", pseudonym(F.col("kind"), F.col("real"), salt, F.lit(attempt), size))
        if done is not None:
            want = want.join(done.select("pseudonym", F.lit(True).alias("taken")), "pseudonym", "left")
        else:
            want = want.withColumn("taken", F.lit(None).cast("boolean"))
        first = F.row_number().over(W.partitionBy("pseudonym").orderBy("kind", "real"))
        want = checkpointed(want.withColumn("nth", first))
        won = want.where("taken is null and nth = 1").select("kind", "real", "pseudonym")
        done = won if done is None else done.unionByName(won)
        left = want.where("taken is not null or nth > 1").select("kind", "real")
        if left.isEmpty():
            return done
    rest = left.withColumn("pseudonym", F.concat(F.col("kind"), F.lit("_"), F.left(F.sha2(F.concat_ws(":", F.lit(salt), "kind", "real"), 256), F.lit(32))))
    return done.unionByName(rest)


def pseudonymise_column(df: DataFrame, col: str, names: DataFrame) -> DataFrame:
    """df with the pseudonym of col in its place; the map is joined by shuffle, as it grows with the data."""
    real = names.select(F.col("real").alias("__real"), F.col("pseudonym").alias("__name"))
    return df.join(real, F.col(col).cast("string") == F.col("__real"), "left").withColumn(col, F.coalesce("__name", F.col(col).cast("string"))).drop("__real", "__name")


def path_names(paths: DataFrame, salt: str, col: str = "path", size: int = 8) -> DataFrame:
    """(kind, real, pseudonym) of the different parts of paths: directories are of kind mod, stems of kind svc; no two have the same name."""
    parts = paths.select(F.explode(_parts(F.col(col))).alias("p")).select("p.kind", "p.real").distinct()
    return mint_pseudonyms(parts, salt, size)


def _parts(path: Column) -> Column:
    """array<struct<pos, kind, real, ext>> of a path's parts; ext is empty but for the last."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    dirs = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p, i: F.struct(i.alias("pos"), F.lit("mod").alias("kind"), p.alias("real"), F.lit("").alias("ext")))
    stem = F.struct((F.size(parts) - 1).alias("pos"), F.lit("svc").alias("kind"), F.regexp_replace(last, r"\.[^.]*$", "").alias("real"), F.regexp_extract(last, r"(\.[^.]*)$", 1).alias("ext"))
    return F.concat(dirs, F.array(stem))


def pseudonymise_paths(paths: DataFrame, names: DataFrame, col: str = "path") -> DataFrame:
    """(path, released) of the different paths: each part by its name from `path_names`, so the map turns released paths back; the
    extension stays. Null paths are none; a path with a part that the map lacks isn't released."""
    parts = paths.where(F.col(col).isNotNull()).select(F.col(col).alias("path")).distinct().select("path", F.explode(_parts(F.col("path"))).alias("p")).select("path", "p.*")
    named = parts.join(bounded(names.select("kind", "real", "pseudonym")), ["kind", "real"], "left")
    whole = named.groupBy("path").agg(F.bool_and(F.col("pseudonym").isNotNull()).alias("whole"), F.array_sort(F.collect_list(F.struct("pos", F.concat("pseudonym", "ext").alias("name")))).alias("p"))
    return whole.where("whole").select("path", F.array_join(F.col("p.name"), "/").alias("released"))


def tokenise_terms(assets: DataFrame, names: DataFrame) -> DataFrame:
    """(path, released, n): whole tokens that have a pseudonym are replaced; n counts them.

    Texts move once, packed, and with them each block's different tokens. A null content is released as null with n 0; rows that repeat a path are released each.
    """
    def put(rows: pa.RecordBatch, known: dict[str, str]) -> pa.RecordBatch:
        out = [replaced(text, known) for text in rows["released"].to_pylist()]
        texts, n = pa.array([x for x, _ in out], rows["released"].type), pa.array([n for _, n in out], pa.int64())
        return pa.RecordBatch.from_arrays([rows["path"], texts, n], ["path", "released", "n"])

    texts = assets.select("path", F.col("content").alias("released"))
    return looked_up(texts, names, put, StructType([*texts.schema.fields, StructField("n", LongType())]), ["released"])


def rehydrate(released: DataFrame, names: DataFrame) -> DataFrame:
    """(path, content, n): the inverse of tokenise_terms."""
    back = names.select(F.col("pseudonym").alias("real"), F.col("real").alias("pseudonym"))
    out = tokenise_terms(released.select("path", F.col("released").alias("content")), back)
    return out.select("path", F.col("released").alias("content"), "n")


def rewrite_nested(df: DataFrame, names: DataFrame) -> DataFrame:
    """df with every whole token of its strings that is a `real` of names as its `pseudonym`: in structs, arrays, map keys and map values of any depth.

    Rows move once, packed, and with them each block's different tokens. Numbers, times and other values stay, nulls too. Of map keys that become equal the first stays.
    """
    def put(rows: pa.RecordBatch, known: dict[str, str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([rewritten(c, known) for c in rows.columns], schema=rows.schema)

    return looked_up(df, names, put, df.schema)


def rehydrate_nested(df: DataFrame, names: DataFrame) -> DataFrame:
    """df with pseudonyms back as real names, wherever they stand in it: the inverse of rewrite_nested."""
    return rewrite_nested(df, names.select(F.col("pseudonym").alias("real"), F.col("real").alias("pseudonym")))


def residual_pseudonyms(released: DataFrame, names: DataFrame, kinds: list[str]) -> DataFrame:
    """Tokens that look like pseudonyms but aren't in the map."""
    shape = r"(?:" + "|".join(kinds) + r")_[0-9a-z]+"
    found = released.select(F.explode(F.regexp_extract_all("released", F.lit(shape), F.lit(0))).alias("pseudonym")).distinct()
    return found.join(names, "pseudonym", "left_anti")


def _is_real(rule: str, value: Column) -> Column:
    """Whether a raw hit counts: not one of the suppressed classes, and a card number by its length and check digit."""
    real = suppression(value).isNull()
    return real & F.length(value).between(13, 19) & F.call_function("luhn_check", value) if rule == "card_number" else real


def redact_text(assets: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(path, released, n_dropped, n_placeheld) and the columns of `keep`: secrets and personal values replaced by placeholders, rule by rule.

    What the detectors suppress stays. The number of lines stays, as a placeholder carries its value's line ends. A null
    content is released as null with counts 0; rows that repeat a path are redacted each.
    """
    out = assets.select("path", *keep, F.col("content").alias("released"), F.lit(0).alias("n_dropped"), F.lit(0).alias("n_placeheld"))
    for rule, kind, _, pattern in DETECTORS:
        out = _without_hits(out, rule, kind, pattern)
    return out.withColumns({c: F.col(c).cast("long") for c in ("n_dropped", "n_placeheld")})


def _without_hits(rows: DataFrame, rule: str, kind: str, pattern: str) -> DataFrame:
    """rows with the real hits of one rule replaced in `released`, and counted."""
    text, count = F.col("released"), "n_dropped" if kind == "secret" else "n_placeheld"
    held = F.lit(rule not in NEEDED)
    for literal in NEEDED.get(rule, ()):
        held = held | text.contains(literal)
    mark = F.lit("<dropped:secret>" if kind == "secret" else f"<str:{rule}>")
    lines = lambda v: F.repeat(F.lit("\n"), F.length(v) - F.length(F.replace(v, F.lit("\n"))))
    put = lambda v: F.when(_is_real(rule, v), F.concat(mark, lines(v))).otherwise(v)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    joined = F.array_join(F.zip_with(F.split(text, pattern, -1), values, lambda gap, v: F.concat(gap, F.coalesce(put(v), F.lit("")))), "")
    n, tried = F.size(F.filter(values, lambda v: _is_real(rule, v))), held & text.rlike(pattern)
    return rows.withColumns({count: F.col(count) + F.when(tried, n).otherwise(0), "released": F.when(tried, joined).otherwise(text)})


def outline_edges(pages: DataFrame, key: str, text: str, most: int = 80) -> DataFrame:
    """(key, edge, target) of a page's shape: its tags and links, at most `most` of each page in order."""
    tags = F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit("<([a-z0-9]+)"), F.lit(1))), lambda t: F.struct(F.lit("tag").alias("edge"), t.alias("target")))
    links = F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit('href="([^"]+)"'), F.lit(1))), lambda t: F.struct(F.lit("link").alias("edge"), t.alias("target")))
    return pages.select(key, F.explode(F.slice(F.sort_array(F.concat(tags, links)), 1, most)).alias("e")).select(key, "e.*")


def release_verbatim(assets: DataFrame, allowed: list[str]) -> DataFrame:
    """(path, level, released): level 2 for allowlisted paths, with lines that hold a secret replaced; level 1 text for the others.

    One pass, without a join. A null content is released as null; rows that repeat a path are released each.
    """
    lines = F.transform(F.split("content", "\n"), lambda x: F.when(x.rlike(_SECRETS), "<line removed>").otherwise(x))
    open_ = any_glob(F.col("path"), allowed)
    safe = redact_text(assets, keep=("content",))
    return safe.select("path", F.when(open_, 2).otherwise(1).alias("level"), F.when(open_, F.array_join(lines, "\n")).otherwise(F.col("released")).alias("released"))


def deny_verdicts(paths: DataFrame, user_globs: list[str] = (), col: str = "path") -> DataFrame:
    """(path, denied, reason, pattern): the user's globs first, then the reasons in their order. A null path is denied as unknown_path."""
    reason, pattern = F.when(F.col(col).isNull(), "unknown_path"), F.lit(None).cast("string")
    for name, globs in reversed((("user_never_send", tuple(user_globs)), *DENIED)):
        for g in reversed(globs):
            hit = F.col(col).rlike(glob_regex(g))
            reason, pattern = F.when(hit, name).otherwise(reason), F.when(hit, g).otherwise(pattern)
    return paths.select(F.col(col).alias("path"), reason.alias("reason"), pattern.alias("pattern")).withColumn("denied", F.col("reason").isNotNull())


def pin_hosts(urls: DataFrame, hosts: list[str], col: str = "url") -> DataFrame:
    """(url, verdict): ok only for https and an exactly pinned host."""
    host = F.lower(F.regexp_extract(col, r"^[A-Za-z]+://([^/:?#]+)", 1))
    verdict = F.when(host == "", "malformed").when(~F.col(col).startswith("https://"), "not_https").when(~host.isin(*hosts), "host_not_pinned").otherwise("ok")
    return urls.select(F.col(col).alias("url"), verdict.alias("verdict"))


def seal_payloads(messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, payload, sha256, bytes): messages in order as [role], line end, text, parted by empty lines."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    text = F.array_join(F.transform(ordered, lambda m: F.concat(F.lit("["), m.role, F.lit("]\n"), m.text)), "\n\n")
    sealed = messages.groupBy(key).agg(text.alias("payload"))
    return sealed.select(key, "payload", F.sha2("payload", 256).alias("sha256"), F.octet_length("payload").cast("long").alias("bytes"))


def gated(payloads: DataFrame, user_globs: list[str], hosts: list[str]) -> DataFrame:
    """payloads with found (real hits) and verdict. All files that a payload stands for are checked: path, and those of the array represents if it has one; a payload
    that names no file is denied like a forbidden one."""
    found = F.filter(detected(F.col("payload")), lambda h: suppression(h.value).isNull())
    globs = [*user_globs, *[g for _, gs in DENIED for g in gs]]
    denied, named = any_glob(F.col("path"), globs), F.col("path").isNotNull()
    if "represents" in payloads.columns:
        denied = F.coalesce(denied, F.lit(False)) | F.coalesce(F.exists("represents", lambda p: p.isNull() | any_glob(p, globs)), F.lit(False))
        named = named | F.coalesce(F.size("represents") > 0, F.lit(False))
    host = F.lower(F.regexp_extract("url", r"^https://([^/:?#]+)", 1))
    verdict = F.when(~named | F.coalesce(denied, F.lit(True)), "denied_path").when(F.size(found) > 0, "forbidden_pattern").when(host.isin(*hosts), "pass").otherwise("host_not_pinned")
    return payloads.withColumn("found", found).withColumn("verdict", verdict)


def gate_payloads(payloads: DataFrame, user_globs: list[str], hosts: list[str]) -> DataFrame:
    """(payload_id, verdict, n_hits) of payloads (payload_id, path, url, payload): blocked, never cleaned; the first failure wins. A null url isn't pinned."""
    return gated(payloads, user_globs, hosts).select("payload_id", "verdict", F.coalesce(F.size("found"), F.lit(0)).cast("long").alias("n_hits"))


def quarantined(checked: DataFrame) -> DataFrame:
    """(payload_id, verdict, rule, pos, line) of the blocked rows of `gated`: the places of the hits, never their values; one row with null places where there's none."""
    rows = checked.where("verdict <> 'pass'").select("payload_id", "verdict", F.explode_outer("found").alias("h"))
    return rows.select("payload_id", "verdict", "h.rule", "h.pos", "h.line")


def quarantine_payloads(payloads: DataFrame, user_globs: list[str], hosts: list[str]) -> DataFrame:
    """(payload_id, verdict, rule, pos, line): each blocked payload with the places of its hits, never their values; one row with null places where it has none."""
    return quarantined(gated(payloads, user_globs, hosts))


def release_preview(assets: DataFrame, user_globs: list[str]) -> DataFrame:
    """(status, n, bytes_before, bytes_after) of what would leave, and the total with status null. One pass, without a join."""
    denied = any_glob(F.col("path"), [*user_globs, *[g for _, globs in DENIED for g in globs]])
    status = F.when(denied, "denied").when(F.col("content").isNull(), "unreadable").otherwise("sent")
    shown = redact_text(assets, keep=("content",)).withColumn("status", status)
    after = F.when(F.col("status") == "sent", F.octet_length("released")).otherwise(0)
    sized = shown.select("status", F.octet_length("content").alias("before"), after.alias("after"))
    return sized.rollup("status").agg(F.count("*").alias("n"), F.sum("before").alias("bytes_before"), F.sum("after").alias("bytes_after"))


def _next_starts(sized: DataFrame, max_chars: int) -> DataFrame:
    """(k0, k1, at, next): for each row, numbered `at` in its project, where the next batch begins if one begins there.

    The rows before that are those whose running sum stays within the sum before the row plus max_chars; how many, tells a count over both kinds of sums in one order.
    """
    sums = sized.select("k0", "k1", F.col("total").alias("sum"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("at"))
    asks = sized.select("k0", "k1", (F.col("total") - F.col("row.size") + max_chars).alias("sum"), F.lit(1).alias("kind"), "at")
    both = Blocks(sums.unionByName(asks), ["k0", "k1"], ["sum", "kind"])
    own = F.count_if(F.col("row.kind") == 0)
    rows = both.rows.withColumn("fit", own.over(both.run.rowsBetween(W.unboundedPreceding, W.currentRow)))
    rows = both.with_carry(rows, own, lambda a, b: a + b).where("row.kind = 1")
    return rows.select("k0", "k1", F.col("row.at").alias("at"), F.greatest(F.col("row.at") + 1, F.col("fit") + F.coalesce("carry", F.lit(0)) + 1).alias("next"))


def _exits(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each place of a piece of a project: where the chain of a batch that begins there, and those after it, leaves the piece."""
    pdf = pdf.sort_values("at")
    first, following = int(pdf["at"].iloc[0]), pdf["next"].to_numpy()
    out = following.copy()
    for i in range(len(pdf) - 1, -1, -1):
        j = following[i] - first
        if j < len(pdf):
            out[i] = out[j]
    return pdf.assign(exit=out)[["k0", "k1", "piece", "at", "next", "exit"]]


def _starts(pdf: pd.DataFrame) -> pd.DataFrame:
    """Each place of a piece, and whether a batch begins there, from the place where the first one does."""
    pdf = pdf.sort_values("at")
    first, following = int(pdf["at"].iloc[0]), pdf["next"].to_numpy()
    starts, entry = np.zeros(len(pdf), bool), pdf["entry"].iloc[0]
    i = len(pdf) if pd.isna(entry) else int(entry) - first
    while i < len(pdf):
        starts[i] = True
        i = following[i] - first
    return pdf.assign(starts=starts)[["k0", "k1", "at", "starts"]]


#: Rows of a project that are one piece of work.
PIECE_ROWS = 1 << 16


def pack_batches(assets: DataFrame, max_chars: int = 60000, project: str = "project", order: str = "doc_id", piece_rows: int = PIECE_ROWS) -> DataFrame:
    """(project, path, batch): greedy packing in order within each project; a batch closes before it would exceed max_chars, and one that exceeds it alone is a batch.

    Where a batch that began at a row would end follows from running sums, for every row at once. Pieces of piece_rows rows then tell where the chain of batches from
    each of their rows leaves them; the chain of a whole project is followed from piece to piece in steps that double, and at last each piece marks its batches. So many tasks pack
    a project of any size. A null content or path counts as empty.
    """
    size = F.coalesce(F.length("content"), F.lit(0)) + F.coalesce(F.length("path"), F.lit(0)) + 64
    sized = assets.select(F.col(project).alias("project"), "path", F.col(order).alias("o"), size.cast("long").alias("size"))
    blocks = Blocks(sized, [F.col("project").isNull(), F.coalesce(F.col("project").cast("string"), F.lit(""))], ["o"])
    rows = blocks.rows.withColumns({"own": F.sum("row.size").over(blocks.run), "n": F.row_number().over(blocks.run)})
    rows = blocks.with_carry(rows, F.struct(F.sum("row.size").alias("size"), F.count("*").alias("n")), lambda a, b: (a[0] + b[0], a[1] + b[1]))
    placed = checkpointed(rows.select("row", "k0", "k1", (F.col("own") + F.coalesce("carry.size", F.lit(0))).alias("total"), (F.col("n") + F.coalesce("carry.n", F.lit(0))).alias("at")))
    chain = _next_starts(placed, max_chars).withColumn("piece", F.floor((F.col("at") - 1) / piece_rows).cast("long"))
    exits = checkpointed(chain.groupBy("k0", "k1", "piece").applyInPandas(_exits, "k0 boolean, k1 string, piece long, at long, next long, exit long"))
    entries = exits.where("at = 1").select("k0", "k1", "at").unionByName(exits.select("k0", "k1", F.col("exit").alias("at"))).distinct()
    steps = [checkpointed(exits.join(entries, ["k0", "k1", "at"], "left_semi").select("k0", "k1", "at", "exit"))]
    while True:
        ahead = steps[-1].select("k0", "k1", F.col("at").alias("exit"), F.col("exit").alias("then"))
        doubled = checkpointed(steps[-1].join(ahead, ["k0", "k1", "exit"]).select("k0", "k1", "at", F.col("then").alias("exit")))
        if doubled.isEmpty():
            break
        steps.append(doubled)
    reached = steps[0].where("at = 1").select("k0", "k1", "at")
    for step in reversed(steps):
        reached = checkpointed(reached.unionByName(step.join(reached, ["k0", "k1", "at"], "left_semi").select("k0", "k1", F.col("exit").alias("at"))).distinct())
    piece = F.floor((F.col("at") - 1) / piece_rows).cast("long").alias("piece")
    first = reached.select("k0", "k1", piece, "at").groupBy("k0", "k1", "piece").agg(F.min("at").alias("entry"))
    marked = exits.join(first, ["k0", "k1", "piece"], "left").groupBy("k0", "k1", "piece").applyInPandas(_starts, "k0 boolean, k1 string, at long, starts boolean")
    begun = Blocks(placed.join(marked, ["k0", "k1", "at"]).select("row", "k0", "k1", "at", "starts"), ["k0", "k1"], ["at"])
    own = F.count_if("row.starts")
    told = begun.with_carry(begun.rows.withColumn("n", own.over(begun.run.rowsBetween(W.unboundedPreceding, W.currentRow))), own, lambda a, b: a + b)
    return told.select("row.row.project", "row.row.path", (F.col("n") + F.coalesce("carry", F.lit(0)) - 1).cast("long").alias("batch"))


def chunk_rows(df: DataFrame, key: str, order: str, n: int = 12) -> DataFrame:
    """df with chunk: rows of a key in order, n to a chunk; a key of any weight is numbered by blocks."""
    rows = numbered(df, [key], [order], "chunk")
    return rows.withColumn("chunk", F.floor((F.col("chunk") - 1) / n))


def egress_rollup(ledger: DataFrame) -> DataFrame:
    """(phase, requests, bytes, destinations, runs)."""
    return ledger.groupBy("phase").agg(F.count("*").alias("requests"), F.sum("bytes").alias("bytes"), F.count_distinct("destination").alias("destinations"), F.count_distinct("run_id").alias("runs"))


def egress_levels(ledger: DataFrame) -> DataFrame:
    """(run_id, destination, level, requests, bytes): by run, by destination, by both and in all; level has a bit for each of the two that is summed over."""
    sums = [F.count("*").alias("requests"), F.sum("bytes").alias("bytes")]
    out = ledger.cube("run_id", "destination").agg(F.grouping_id().cast("int").alias("level"), *sums)
    return out.select("run_id", "destination", "level", "requests", "bytes")


def last_requests(ledger: DataFrame, run_id: Column | None = None, most: int = 40) -> DataFrame:
    """The `most` newest rows of the ledger, or of one run, newest first by nth: each task keeps its newest, so none sorts the ledger. Ties go by sha256."""
    own = ledger if run_id is None else ledger.where(F.col("run_id") == run_id)
    newest = own.orderBy(F.desc("ts"), "sha256").limit(most)
    return newest.withColumn("nth", F.row_number().over(W.orderBy(F.desc("ts"), "sha256")))


def detect_terms(pages: DataFrame, stop: list[str]) -> DataFrame:
    """(term, n): candidate names from hosts and titles, 3 to 64 characters, without stop words."""
    host = F.split(host_of(F.col("url")), "\\.")[0]
    title = F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    words = F.split(F.regexp_replace(F.lower(title), "[^a-z ]", ""), " +")
    terms = pages.select(F.explode(F.concat(F.array(host), words)).alias("term")).where(F.length("term").between(3, 64) & ~F.col("term").isin(*stop))
    return terms.groupBy("term").agg(F.count("*").alias("n"))
