"""Rule scans on a small repository of our own, with an exact golden set."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lintlake.functions.masking import mask_secrets, redact_corpus
from lintlake.operators import analytics
from lintlake.operators.calls import CallMatcher, calls_of
from lintlake.operators.rules import RULEBOOK, Rule
from lintlake.operators.scan import scan_files, unique_findings

# Key-shaped text is put together here, never stored.
GITHUB = "ghp_" + "Fake" * 6
STRIPE = "_".join(["sk", "live", "FAKE" * 5])
SENDGRID = ".".join(["SG", "a" * 20, "b" * 20])
TWILIO = "AC" + "0f" * 16
RESEND = "re_" + "c" * 20

REPO = [
    ("app/api/orders/route.ts", "import x from 'y';\nexport async function POST(request) {\n  const b = await request.json();\n"
                                "  await stripe.paymentIntents.create({ amount: b.amount });\n}\nexport const GET = async () => {};\n"),
    ("app/api/mine/route.ts", "export async function GET() {\n  const s = await getServerSession();\n}\n"),
    ("pages/api/hook-webhook.ts", "export default async function (req, res) {\n  const e = JSON.parse(req.body);\n}\n"),
    ("api/list.js", "module.exports = async (req, res) => { res.json([]); };\n"),
    ("api/_lib/helper.js", "module.exports = async (req, res) => { res.json([]); };\n"),
    ("api/safe.js", "const u = requireUser();\nmodule.exports = async (req, res) => {};\n"),
    ("components/Panel.tsx", '"use client";\n\nconst db = createClient(\n  URL,\n  process.env.SUPABASE_SERVICE_ROLE_KEY!\n);\n'),
    ("lib/a.js", f'const k = "{GITHUB}";\n// const k = "{GITHUB}";\n'),
    ("lib/b.ts", "cookies().set('a', v);\ncookies().set('a', v, {\n  httpOnly: true });\nregex.exec(req.body.x);\nexec(`ls ${req.query.d}`);\n"),
    ("svc/views.py", "def get(request):\n    return 1\n"),
    ("svc/safe_views.py", "class AView:\n    permission_classes = []\n"),
    ("svc/run.py", "x = 1  # requests.get(u, verify=False)\nrequests.post(u,\n  verify=False)\nrequests.post(u, verify=False)\n"),
    ("cmd/main.go", 'http.HandleFunc("/api/x", h)\n'),
    ("cmd/auth.go", 'http.HandleFunc("/api/x", middleware(h))\n'),
    ("db/1.sql", "-- grant select on t to anon;\nGRANT select on t TO public;\n"),
    (".env.local", "NEXT_PUBLIC_TOKEN=abc\nTOKEN=abc\n"),
    ("notes.env.txt", "NEXT_PUBLIC_TOKEN=abc\n"),
]
GOLDEN = {
    ("nextjs.route_handler_no_auth", "app/api/orders/route.ts", 2), ("nextjs.route_handler_no_auth", "app/api/orders/route.ts", 6),
    ("stripe.idempotency_missing", "app/api/orders/route.ts", 4),
    ("webhooks.unverified_signature", "pages/api/hook-webhook.ts", 1),
    ("auth.unprotected_route", "api/list.js", 1),
    ("supabase.service_role_client_side", "components/Panel.tsx", 1),
    ("supabase.service_role_in_client_bundle", "components/Panel.tsx", 3),
    ("secrets.github_pat", "lib/a.js", 1), ("secrets.literal_credential", "lib/a.js", 1),
    ("nextjs.cookies_missing_options", "lib/b.ts", 1), ("injection.shell_command", "lib/b.ts", 5),
    ("py.unprotected_route", "svc/views.py", 1), ("py.tls_verify_disabled", "svc/run.py", 4),
    ("go.unprotected_route", "cmd/main.go", 1), ("db.public_grant", "db/1.sql", 2),
    ("secrets.env_public_secret", ".env.local", 1),
}


@pytest.fixture(scope="module")
def findings(files_of):
    return unique_findings(scan_files(files_of(REPO))).cache()


def test_golden_set(findings, spark):
    found = {(r["rule"], r["file"], r["line"]) for r in findings.collect()}
    assert found == GOLDEN
    expected = spark.createDataFrame(sorted(GOLDEN), "rule string, file string, line int")
    quality = analytics.detection_quality(findings, expected, ["rule", "file", "line"]).first()
    assert (quality["missed"], quality["unexpected"], quality["recall"], quality["precision"]) == (0, 0, 1.0, 1.0)


def test_expected_lines_exist(files_of, spark):
    expected = spark.createDataFrame([("r", f, n) for _, f, n in GOLDEN] + [("r", "api/list.js", 99)],
                                     "repo_id string, file string, line int")
    assert [r["line"] for r in analytics.expected_in_range(expected, files_of(REPO)).collect()] == [99]


def test_same_rows_for_any_partitioning(files_of, findings):
    ids = sorted(r["id"] for r in findings.collect())
    for n in (1, 7):
        again = unique_findings(scan_files(files_of(REPO).repartition(n)))
        assert sorted(r["id"] for r in again.collect()) == ids


def test_evidence_is_masked(files_of):
    lines = "\n".join([f"a = '{GITHUB}'", STRIPE, SENDGRID, TWILIO, RESEND, "SECRET_KEY = 'abc'"])
    rows = scan_files(files_of([("a.py", lines), ("b.txt", lines)])).collect()
    assert len(rows) == 11
    for row in rows:
        for secret in (GITHUB, STRIPE, SENDGRID, TWILIO, RESEND, "'abc'"):
            assert secret not in row["evidence"]
    # A second mask changes nothing.
    texts = files_of([(str(i), r["evidence"]) for i, r in enumerate(rows)])
    assert texts.where(mask_secrets(F.col("content")) != F.col("content")).count() == 0


def test_strict_masks_leave_quoted_and_uncovered_kinds(files_of):
    rows = files_of([("a", "SECRET_KEY = 'abc'"), ("b", SENDGRID), ("c", "password: hunter2 x")])
    strict = {r["path"]: r["m"] for r in rows.select("path", mask_secrets(F.col("content"), True).alias("m")).collect()}
    full = {r["path"]: r["m"] for r in rows.select("path", mask_secrets(F.col("content")).alias("m")).collect()}
    assert strict["a"] == "SECRET_KEY = 'abc'" and full["a"] == "SECRET_KEY = '[redacted]'"
    assert strict["b"] == SENDGRID and full["b"] == "SG.[redacted]"
    assert strict["c"] == full["c"] == "password: [redacted] x"


def test_redact_whole_text_beyond_evidence_length(files_of):
    text = "x " * 400 + GITHUB
    out = redact_corpus(files_of([("a", text)]), "content").first()["content"]
    assert out == "x " * 400 + "ghp_[redacted]"


def test_one_long_word_is_masked_quickly(files_of):
    out = redact_corpus(files_of([("a", "a" * 300_000 + "token"), ("b", "x" * 1000 + "_TOKEN=abc")]), "content")
    assert {r["content"][-10:] for r in out.collect()} == {"aaaaatoken", "[redacted]"}


def test_user_rule_beside_the_built_in_ones(files_of):
    own = Rule("own.todo", "low", "Open task", "Style", "Do it.", "line", (), "TODO", needles=("TODO",), raw=True)
    rows = scan_files(files_of([("a.txt", "x\nTODO y\n")]), [*RULEBOOK, own]).collect()
    assert [(r["rule"], r["line"], r["evidence"]) for r in rows] == [("own.todo", 2, "a.txt:2 TODO y")]


def test_windows_line_ends_and_trailing_lines(files_of):
    rows = scan_files(files_of([("a.sql", "select 1;\r\n\r\ngrant all on t to anon;\r\n")])).collect()
    assert [(r["line"], r["evidence"]) for r in rows] == [(3, "a.sql:3 grant all on t to anon;")]


def test_null_and_empty_content(spark):
    files = spark.createDataFrame([("r", "a.js", None), ("r", "b.py", "")], "repo_id string, path string, content string")
    assert scan_files(files).count() == 0


def test_unknown_severity_weighs_nothing_and_empty_scan_scores_full(spark):
    scans = spark.createDataFrame([("a",), ("b",), ("c",)], "repo_id string")
    rows = [("a", "critical", False)] * 9 + [("b", "odd", False), ("b", "low", True), ("b", "low", False)]
    found = spark.createDataFrame(rows, "repo_id string, severity string, suppressed boolean")
    scores = {r["repo_id"]: r["score"] for r in analytics.scan_score(scans, found).collect()}
    assert scores == {"a": 0, "b": 98, "c": 100}


def test_fail_gate_none_never_fails(spark, findings):
    scans = spark.createDataFrame([("r",), ("empty",)], "repo_id string")
    gate = {t: {r["repo_id"]: r["failed"] for r in analytics.fail_gate(scans, findings, t).collect()} for t in ("none", "critical")}
    assert gate == {"none": {"r": False, "empty": False}, "critical": {"r": True, "empty": False}}


def test_diff_parts_are_disjoint(findings):
    now, before = findings.where("line > 1"), findings.where("line < 4")
    rows = analytics.scan_diff(now, before).collect()
    by = {c: {r["id"] for r in rows if r["change"] == c} for c in ("added", "removed", "persisted")}
    assert not by["added"] & by["removed"] and not by["added"] & by["persisted"]
    summary = analytics.scan_diff_summary(now, before).first()
    assert (summary["added"], summary["removed"], summary["persisted"]) == tuple(len(by[c]) for c in ("added", "removed", "persisted"))


# ------------------------------------------------------- rules over call spans
PAD = "/* " + "x" * 2000 + " */ "


CALLS = [
    ("injection.shell_command", "exec(`ls ${req.query.d}`)", 1),
    ("injection.shell_command", f"exec({PAD}join(a(1), `${{req.query.d}}`))", 1),
    ("injection.shell_command", "exec('ls')\nshow(req.query.d)", 0),
    ("nextjs.cookies_missing_options", "cookies().set('sid', v)\nother({ httpOnly: true })", 1),
    ("nextjs.cookies_missing_options", f"cookies().set('sid', f(v), {{ {PAD} httpOnly: true }})", 0),
    ("stripe.idempotency_missing", f"stripe.charges.create({{ a: f(1), {PAD} }}, {{ idempotencyKey: k }})", 0),
    ("stripe.idempotency_missing", "stripe.charges.create({ a: 1 })\nlog({ idempotencyKey: k })", 1),
    ("auth.weak_jwt_secret", "jwt.sign(user, 'changeme')", 1),
    ("auth.weak_jwt_secret", f"jwt.sign({{ id: 1, note: '{'n' * 900}' }}, 'changeme')", 1),
    ("infra.open_cors", f"cors({{ {PAD} origin: '*' }})", 1),
    ("infra.open_cors", "cors({ origin: list })\nset({ origin: '*' })", 0),
    ("logic.mass_assignment", f"prisma.user.update({{ where: f(1), {PAD} data: req.body }})", 1),
    ("logic.predictable_random", f"token = {'a + ' * 200}Math.random()", 1),
    ("injection.sql_template", f"db.query(`select {'c, ' * 400} ${{req.params.id}}`)", 1),
    ("injection.sql_concat", f"db.query('select {'c, ' * 400}' + id)", 1),
    ("injection.shell_command", "exec(a(b(c(d(e(1))))), req.query.x)", 1),
    ("injection.shell_command", 'exec("echo ) " + req.query.x)', 1),
    ("injection.shell_command", "exec('the input')\n/* exec(req.body) */ /a(/.exec(req.body)\nlist[0].exec(req.body)\nfunction exec(req) {}", 0),
    ("injection.shell_command", "x = `a ${exec(`b ${req.query.c}`)} d`", 1),
    ("nextjs.cookies_missing_options", "cookies().set('s', f(g(h(i(j(1))))), { httpOnly: true })", 0),
    ("nextjs.cookies_missing_options", "cookies().set('s', ':(', { httpOnly: true })", 0),
    ("nextjs.cookies_missing_options", "(await cookies()).set('a', 1)\nNextResponse.next()\n  .cookies.set('b', \"httpOnly\")", 2),
    ("stripe.idempotency_missing", 'stripe.charges.create({ description: "a) b" }, { idempotencyKey: k })', 0),
    ("infra.open_cors", "cors({ f: a(b(c(d(1)))), origin: '*' })", 1),
    ("infra.open_cors", "cors({ nested: { origin: '*' }, note: \"origin: '*'\" })", 0),
    ("auth.weak_jwt_secret", "jwt.sign({a:{b:1}}, 'short')", 1),
    ("auth.weak_jwt_secret", "jwt.sign(make(user, 1), 'changeme')", 1),
    ("auth.weak_jwt_secret", "jwt.sign(user, `${secret}`)\njwt.sign(user, 'x' + secret)\njwt.sign('short', key)", 0),
    ("logic.mass_assignment", "prisma.user.update({ where: { data: body }, data: { name } })", 0),
    ("logic.mass_assignment", "prisma.user.create({ data })", 1),
    ("supabase.service_role_in_client_bundle", "'use client'\ncreateClient(u(1, 2), env.SERVICE_ROLE!)", 1),
    ("supabase.service_role_in_client_bundle", "createClient(url, env.SERVICE_ROLE)", 0),
]


def test_call_rules_see_the_whole_call(files_of):
    files = files_of([(f"f{n}.js", code + "\n") for n, (_, code, _) in enumerate(CALLS)])
    found = {}
    for r in scan_files(files).collect():
        found.setdefault((r["file"], r["rule"]), []).append(r["line"])
    assert [(rule, code[:60], len(found.get((f"f{n}.js", rule), []))) for n, (rule, code, _) in enumerate(CALLS)] == [
        (rule, code[:60], expected) for rule, code, expected in CALLS]


@pytest.mark.parametrize("source, hits", [
    ("cookies().set(" + "f(a)," * 100_000 + ")", 1), ("exec(" + "f(a)," * 3000 + "req.body)", 1), ("exec(function(){f(a);});" * 40_000, 0),
    ("exec(" * 50_000 + "req.body" + ")" * 50_000, 50_000), ("exec(" * 100_000, 0), ("`${" * 100_000, 0), ("/*" * 200_000, 0),
    ("'" * 300_001, 0), ("{([" * 50_000 + ")}" * 50_000, 0), ("exec(req.body);" * 60_000, 60_000), ("/[" * 100_000, 0), ("a?." * 100_000, 0), ("'\\" * 150_000, 0),
])
def test_calls_are_found_in_linear_time(source, hits):
    """Minified bundles, deep nests and texts that are no code: seconds at most, and no end of the process."""
    matcher = CallMatcher([(i, r) for i, r in enumerate(RULEBOOK) if r.scope == "call"])
    start = time.perf_counter()
    assert len(list(matcher.hits(source, [True] * len(matcher.rules)))) == hits
    assert time.perf_counter() - start < 30


def test_one_line_bundle_does_not_end_the_application(files_of):
    code = "cookies().set(" + "f(a)," * 100_000 + "b)"
    rows = unique_findings(scan_files(files_of([("a.js", code), ("b.js", "exec(function(){f(a);}" * 5000), ("c.js", None or "")]))).collect()
    assert [(r["rule"], r["file"], r["line"]) for r in rows] == [("nextjs.cookies_missing_options", "a.js", 1)]


def brute_calls(source):
    """(callee, arguments) by matching brackets one by one, for texts of names, brackets, commas and strings."""
    out = []
    for m in re.finditer(r"[a-z]+\(", source):
        if source[:m.start()].count("'") % 2:
            continue
        depth, cut, quoted, at = 1, [m.end()], False, m.end()
        while at < len(source) and depth:
            c = source[at]
            quoted ^= c == "'"
            if not quoted:
                depth += (c in "([{") - (c in ")]}")
                if depth == 1 and c == ",":
                    cut.append(at + 1)
            at += 1
        if not depth:
            out.append((m[0][:-1], [source[a:b - 1] for a, b in zip(cut, [*cut[1:], at], strict=True)]))
    return out


@pytest.mark.parametrize("seed", range(5))
def test_arguments_equal_matched_brackets(seed):
    rng = random.Random(seed)

    def make(depth):
        kind = rng.randint(0, 6 if depth else 1)
        inner = lambda: ",".join(make(depth - 1) for _ in range(rng.randint(0, 3)))
        return ["ab", "'x) {y'", "call(%s)", "[%s]", "(%s)", "f(%s)", "g(ab,%s)"][kind].replace("%s", inner() if depth else "")

    for _ in range(200):
        source = ";".join(make(4) for _ in range(3))
        found, code = calls_of(source, re.compile("[a-z]+"))
        assert len(code) == len(source)
        want = [(name, args if args != [""] else []) for name, args in brute_calls(source)]
        got = [(f.callee, [source[v.start:v.end] for v in f.values]) for f in found]
        assert [(n, [a for a in args if a]) for n, args in got] == [(n, [a for a in args if a]) for n, args in want]
