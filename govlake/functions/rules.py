"""Rule tables, and the column expressions made of them. Patterns hold in Java's and in RE2's dialect alike."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("critical", "high", "medium", "low", "info")

#: (rule, kind, severity, pattern). Repeats before a telling character are bounded, so that long runs cost no more than their length. Fixed values.
DETECTORS = (
    ("provider_key", "secret", "critical", r"sk-(?:proj|ant)-[A-Za-z0-9_-]{16,}"),
    ("access_key", "secret", "critical", r"AKIA[0-9A-Z]{16}"),
    ("forge_token", "secret", "critical", r"gh[pousr]_[A-Za-z0-9]{36}"),
    ("map_key", "secret", "critical", r"AIza[0-9A-Za-z_-]{35}"),
    ("payment_key", "secret", "critical", r"sk_live_[A-Za-z0-9]{16,}"),
    ("private_key", "secret", "critical", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    ("database_url", "secret", "critical", r"[a-z][a-z0-9+]{0,30}://[^ :/@\"']{1,128}:[^ :/@\"']{1,128}@[^ /\"']{1,255}"),
    ("signed_token", "secret", "critical", r"eyJ[A-Za-z0-9_-]{8,400}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    ("assigned_secret", "secret", "high", r"(?:token|secret|password|api_key|TOKEN|SECRET|PASSWORD|API_KEY) *[=:] *[\"'][^\"' ]{16,}[\"']"),
    ("email", "personal", "medium", r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}"),
    ("phone_e164", "personal", "medium", r"\+[0-9][0-9 ().-]{7,17}[0-9]"),
    ("ghana_card", "personal", "critical", r"GHA-[0-9]{9}-[0-9]"),
    ("bank_number", "personal", "critical", r"(?:BVN|bvn)[^0-9]{0,10}[0-9]{11}"),
    ("social_security", "personal", "critical", r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    ("aadhaar", "personal", "critical", r"(?:Aadhaar|aadhaar)[^0-9]{0,10}[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}"),
    ("card_number", "personal", "critical", r"[0-9]{13,}"),
)
#: Strings one of which a text must hold for a rule to be tried. Fixed values.
NEEDED = {
    "provider_key": ("sk-",),
    "access_key": ("AKIA",),
    "forge_token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "map_key": ("AIza",),
    "payment_key": ("sk_live_",),
    "private_key": ("PRIVATE KEY-----",),
    "database_url": ("://",),
    "signed_token": ("eyJ",),
    "assigned_secret": ("token", "secret", "password", "api_key", "TOKEN", "SECRET", "PASSWORD", "API_KEY"),
    "email": ("@",),
    "phone_e164": ("+",),
    "ghana_card": ("GHA-",),
    "bank_number": ("BVN", "bvn"),
    "social_security": ("-",),
    "aadhaar": ("Aadhaar", "aadhaar"),
}
#: Values that no finding is made of. Fixed values.
SUPPRESSED = (
    ("documentation_address", r"@example\.(?:com|org|net)$"),
    ("no_reply", r"^(?:noreply|no-reply)@"),
    ("environment_reference", r"process\.env\."),
    ("placeholder", r"YOUR_"),
)
ENTROPY_SHAPE = r"[A-Za-z0-9+/=_-]{20,}"


def severity_rank(severity: Column) -> Column:
    """0 for critical to 4 for info, 99 for anything else."""
    at = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity)
    return F.when(at > 0, at - 1).otherwise(99).cast("int")


def _line_ends(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n")))


def placed_hits(text: Column, pattern: str) -> Column:
    """array<struct<value, pos, line>> of a pattern's matches from left to right: characters before it, and its line from 1 on."""
    pairs = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1), lambda v, gap: F.struct(v.alias("v"), gap.alias("gap")))
    none = F.array().cast("array<struct<value:string,pos:int,line:int>>")

    def step(at: Column, x: Column) -> Column:
        pos, line = at.pos + F.length(x.gap), at.line + _line_ends(x.gap)
        hit = F.array(F.struct(x.v.alias("value"), pos.alias("pos"), line.alias("line")))
        return F.struct((pos + F.length(x.v)).alias("pos"), (line + _line_ends(x.v)).alias("line"), F.concat(at.out, hit).alias("out"))

    start = F.struct(F.lit(0).alias("pos"), F.lit(1).alias("line"), none.alias("out"))
    return F.aggregate(F.filter(pairs, lambda x: x.v.isNotNull()), start, step, lambda at: at.out)


def detected(text: Column, kinds: tuple[str, ...] = ("secret", "personal")) -> Column:
    """array<struct<rule, kind, severity, value, pos, line>> of all raw hits of these kinds, in the order of the rules.

    A rule is tried on texts that hold one of its NEEDED strings; a hit's place is worked out only where there is one.
    """

    def of(rule: str, kind: str, severity: str, pattern: str) -> Column:
        held = F.lit(False)
        for literal in NEEDED.get(rule, ()):
            held = held | text.contains(literal)
        found = placed_hits(text, pattern)
        if rule == "card_number":
            found = F.filter(found, lambda h: F.length(h.value).between(13, 19) & F.call_function("luhn_check", h.value))
        named = F.transform(found, lambda h: F.struct(F.lit(rule).alias("rule"), F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), h.value.alias("value"), h.pos.alias("pos"), h.line.alias("line")))
        tried = text.rlike(pattern) if rule not in NEEDED else held & text.rlike(pattern)
        return F.when(tried, named).otherwise(F.array().cast("array<struct<rule:string,kind:string,severity:string,value:string,pos:int,line:int>>"))

    return F.concat(*[of(*d) for d in DETECTORS if d[1] in kinds])


def suppression(value: Column) -> Column:
    """Name of the first class that suppresses a value, or null."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(SUPPRESSED):
        out = F.when(value.rlike(pattern), name).otherwise(out)
    return out


def glob_regex(glob: str) -> str:
    """A regular expression for a path glob; one without a slash also matches the last part of a path."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = glob[i]
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), i + 1
    return "^" + ("(?:.*/)?" if "/" not in glob else "") + out + "$"


def window_hashes(words: Column, size: int) -> Column:
    """64-bit hash of each `size` neighbours of an array of strings, which is evaluated once; empty where it has fewer."""

    def of(h: Column) -> Column:
        joined = h
        for k in range(1, size):
            joined = F.zip_with(joined, F.slice(h, F.lit(k + 1), F.size(h)), lambda a, b: F.xxhash64(a, b))
        return F.slice(joined, F.lit(1), F.greatest(F.size(h) - (size - 1), F.lit(0)))

    return F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), of)[0]


def any_glob(path: Column, globs) -> Column:
    return path.rlike("|".join(glob_regex(g) for g in globs)) if globs else F.lit(False)


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without a leading www., null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/:?#]+)", 1))
    return F.when(host != "", F.regexp_replace(host, r"^www\.", ""))


def slug(text: Column, size: int = 48) -> Column:
    return F.left(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(size))


def mask(value: Column) -> Column:
    """The first four characters and an ellipsis."""
    return F.concat(F.left(value, F.lit(4)), F.lit("…"))
