"""Rules, SQL functions, nested values and exports on planted rows."""

import pytest
from pyspark.sql import functions as F

from govlake.functions import sql
from govlake.functions.rules import any_glob, mask, severity_rank
from govlake.operators import detect, gaps, redact
from govlake.sources import files


def found(spark, path, text):
    df = spark.createDataFrame([(path, text)], "path string, content string")
    return {r.rule for r in detect.scan_misconfig(df).collect()}


@pytest.mark.parametrize(
    "path,text,rule,hit",
    [
        ("src/app/page.tsx", "createClient(SUPABASE_SERVICE_KEY)", "privileged_key_in_client", True),
        ("src/app/api/route.ts", "createClient(SUPABASE_SERVICE_KEY)", "privileged_key_in_client", False),
        ("lib/x.ts", "import.meta.env.VITE_MY_SECRET_TOKEN", "privileged_key_in_client", True),
        ("lib/x.ts", "NEXT_PUBLIC_URL and SERVICE_ROLE", "privileged_key_in_client", False),
        ("a.py", "'Access-Control-Allow-Origin': '*'", "permissive_cors", True),
        ("a.ts", "app.use(cors({ origin: true }))", "permissive_cors", True),
        ("a.py", "CORS(app, origins=['*'])", "permissive_cors", True),
        ("a.ts", "origin: 'https://a.org'", "permissive_cors", False),
        ("m.tf", 'acl    = "public-read"', "public_bucket", True),
        ("m.tf", "public_access_block = false", "public_bucket", True),
        ("m.json", '{"public": true}', "public_bucket", True),
        ("m.tf", 'acl = "private"', "public_bucket", False),
        (".github/workflows/a.yml", "- uses: a/b@" + "0123456789" * 4, "unpinned_action", False),
        (".github/workflows/a.yml", "- uses: a/b/sub@main", "unpinned_action", True),
        ("vercel.json", "content-security-policy", "missing_security_headers", True),
        ("src/helmet.ts", "Content-Security-Policy Strict-Transport-Security", "missing_security_headers", False),
        ("x/Dockerfile", "FROM a\nUSER redis\n", "container_runs_as_root", False),
        ("Dockerfile.dev", "FROM a\nUSER root\n", "container_runs_as_root", True),
        ("Dockerfile", "FROM a\n  user app:app", "container_runs_as_root", False),
        ("s.py", "DEBUG = True", "debug_enabled", True),
        ("s.test.ts", "debug: true", "debug_enabled", False),
        ("s.py", "DEBUG = Trueish", "debug_enabled", False),
        ("s.sh", "export NODE_TLS_REJECT_UNAUTHORIZED=0", "tls_verification_disabled", True),
        ("s.go", "InsecureSkipVerify: true", "tls_verification_disabled", True),
        ("s.ts", "{ rejectUnauthorized: true }", "tls_verification_disabled", False),
        ("s.ts", None, "missing_security_headers", False),
    ],
)
def test_misconfiguration_on_both_sides(spark, path, text, rule, hit):
    assert (rule in found(spark, path, text)) == hit


def test_claims_on_both_sides(spark):
    says = {
        "no_personal": (["We do not store personal data.", "It never collects anything", "Anonymised data only"], ["We store personal data", "No cookies. Personal data is kept", "anonymous users"]),
        "no_sensitive": (["no health records", "without any biometric input"], ["health records", "not slow; health matters"]),
        "no_ai": (["No AI is used", "it doesn't call a language model"], ["AI first", "no fees"]),
        "no_vendor": (["data is not shared with anyone", "never goes to third parties"], ["third-party tools", "vendors"]),
        "encrypted": (["All is encrypted", "encryption at rest"], ["nothing is not known", "it is not encrypted"]),
        "deletable": (["users can delete it", "the right to be forgotten"], ["you cannot delete it", None]),
    }
    rows = [(f"{claim}:{i}:{yes}", text) for claim, both in says.items() for yes, texts in zip((True, False), both, strict=True) for i, text in enumerate(texts)]
    got = {r.project: r for r in gaps.read_claims(spark.createDataFrame(rows, "project string, text string")).collect()}
    assert [k for k, r in got.items() if str(r[k.split(":")[0]]) != k.split(":")[2]] == []


def test_sql_functions_are_those_of_the_library_and_inlined(spark):
    sql.register(spark)
    globs = ["**/a/*.txt", "*.txt", "src/**", "a?c", "x.(y)+[z]", "**/*.min.js", "{a}$^|b"]
    paths = ["p/a/q.txt", "a/q.txt", "q.txt", "src/a/b", "src", "abc", "a/c", "x.(y)+[z]", "xa(y)+[z]", "d/e.min.js", "{a}$^|b", "d/x.(y)+[z]"]
    df = spark.createDataFrame([(p, g) for p in paths for g in globs], "path string, glob string")
    got = {(r.path, r.glob): r.h for r in df.selectExpr("*", "glob_like(path, glob) h").collect()}
    for g in globs:
        for r in df.where(F.col("glob") == g).select("path", any_glob(F.col("path"), [g]).alias("h")).collect():
            assert got[r.path, g] == r.h, (r.path, g)
    values = spark.createDataFrame([(v,) for v in ("critical", "info", "odd", None, "abcdef")], "v string")
    both = values.select(severity_rank(F.col("v")).alias("a"), F.expr("severity_rank(v)").alias("b"), mask(F.col("v")).alias("c"), F.expr("mask_value(v)").alias("d"))
    assert all(r.a == r.b and r.c == r.d for r in both.collect())
    values.createOrReplaceTempView("values_of_test")
    plan = spark.sql("SELECT placeholder_of(v) a, glob_like(v, 'a*') b, mask_value(v) c, severity_rank(v) d FROM values_of_test")._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in ("UDF", "SQLFunction", "placeholder_of", "glob_like", "mask_value", "severity_rank") if x in plan]


@pytest.mark.parametrize(
    "value,placeholder",
    [
        ("http://[::1]:3000/x", "<str:url:internal>"), ("https://host.docker.internal", "<str:url:internal>"), ("http://localhost", "<str:url:internal>"), ("https://api.pay.com/v1", "<str:url:external>"),
        ("mongodb+srv://h/d", "<str:connection_string>"), ("WITH x AS (SELECT 1)", "<str:sql:len:20>"), ("  insert\n into t", "<str:sql:len:16>"), ("withdraw x as", "<str:len:13>"),
        ("multipart/form-data", "multipart/form-data"), ("X-Request-Id", "X-Request-Id"), ("created_at", "created_at"), (" ", " "), ("/api/users/[id]", "<str:path:segments:3>"),
        ("kofi@corp.gh", "<str:email>"), ("sk-ant-" + "X" * 26, "<dropped:secret>"), ("You are a helpful assistant. Answer the question in one short line.", "<str:prompt:len:67>"), ("openai/gpt-4o", "openai/gpt-4o"), ("openai/a b", "<str:len:10>"),
    ],
)
def test_placeholders(spark, value, placeholder):
    assert spark.createDataFrame([(value,)], "v string").select(redact.placeholder_of(F.col("v"))).first()[0] == placeholder


def test_nested_values_come_back(spark):
    rows = [
        (1, ("kofi met ama_2", ["kofi", None, "x.kofi.y"], {"kofi": [{"a": "ama"}], "t_1": None}), None, 5),
        (2, (None, None, {}), "kofi$ kofi", None),
        (3, None, "", 7),
        (3, None, "", 7),
    ]
    schema = "id long, s struct<t:string,l:array<string>,m:map<string,array<struct<a:string>>>>, known string, at int"
    df = spark.createDataFrame(rows, schema)
    names = spark.createDataFrame([("kofi", "p_1"), ("ama", "p_2"), ("never", "p_3")], "real string, pseudonym string")
    out = redact.rewrite_nested(df, names)
    assert out.schema.simpleString() == df.schema.simpleString()
    got = {r.id: r for r in out.collect()}
    assert got[1].s.t == "p_1 met ama_2" and got[1].s.l == ["p_1", None, "x.p_1.y"] and got[1].s.m["p_1"][0].a == "p_2" and got[2].known == "kofi$ p_1"
    back = redact.rehydrate_nested(out, names)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert redact.rewrite_nested(df.limit(0), names).count() == 0
    clash = spark.createDataFrame([({"kofi": 1, "p_1": 2},)], "m map<string,int>")
    assert redact.rewrite_nested(clash, names).first().m == {"p_1": 1}


def test_file_trees_leave_out_what_is_too_long_before_it_is_read(spark, tmp_path):
    for name, body in {"a/x.py": b"ok", "a/long.py": b"y" * 3000, "node_modules/x.py": b"ok", "a/nul.py": b"a\0b", "b.png": b"ok", "empty.txt": b""}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    out = files.scan_files(spark, f"file://{tmp_path}", max_kb=2)
    assert {(r.path, r.size) for r in out.collect()} == {("a/x.py", 2)}
    assert "LessThanOrEqual(length,2048)" in out._jdf.queryExecution().toString()


def test_versions_of_any_length(spark):
    c = spark.createDataFrame([("x", "e", "p", v) for v in ("1.2.3.4.5.6.6", "1.2.3.4.5.6.7", "1.2.3.4.5.6.7.0", "1.2", "*")], "component string, ecosystem string, package string, version string")
    a = spark.createDataFrame([("e", "p", "1.2.3.4.5.6.7", "A", "high")], "ecosystem string, package string, fixed string, advisory string, severity string")
    assert {r.version for r in detect.dependency_vulns(c, a).collect()} == {"1.2.3.4.5.6.6", "1.2"}
