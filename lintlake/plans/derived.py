"""Inputs derived from the given tables: a file corpus with planted flaws.

The raw documents hold no match of most rules, so each document becomes one
source file: its whole text plus one planted flaw chosen by its id. Token tails
come from a hash of the id, so nothing key-shaped is stored in the code.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.functions.sqltext import literal
from lintlake.plans.templates import pick_sql

# (path, planted text) per file kind; kind = doc_id % 8, entry = (doc_id / 8) % length.
PLANTED: list[list[tuple[str, str]]] = [
    [  # javascript
        ("{src}/{id}.js", 'const gh = "ghp_{h24}";'),
        ("{src}/{id}.js", 'localStorage.setItem("token", value{id});'),
        ("{src}/{id}.js", 'const t = jwt.sign({ id: 7 }, "short-{h8}", opts);'),
        ("{src}/{id}.js", "child_process.exec(`ls ${req.query.dir}`);"),
        ("{src}/{id}.js", "const out = eval(source{id});"),
        ("{src}/{id}.js", "db.query(`SELECT * FROM t WHERE id = ${req.params.id}`);"),
        ("{src}/{id}.js", 'db.query("SELECT * FROM t WHERE id = " + name);'),
        ("{src}/{id}.js", "prisma.user.update({\n  where: { id },\n  data: body\n});"),
        ("{src}/{id}.js", "const resetCode = 1 + Math.random();"),
        ("{src}/{id}.js", "app.use(cors({\n  origin: '*'\n}));"),
        ("{src}/{id}.js", "panel.innerHTML = note{id};"),
        ("{src}/{id}.jsx", "<div dangerouslySetInnerHTML={{ __html: note }} />"),
        ("{src}/pages/api/{id}.js", "module.exports = (req, res) => res.json(1);"),
        ("{src}/lib/webhook-{id}.js", "const payload = JSON.parse(raw);"),
        ("{src}/{id}.js", "const k = import.meta.env.VITE_PRIVATE_VALUE;"),
        ("{src}/app/p{id}/route.ts", "export async function POST(request) {\n  return Response.json({});\n}"),
        ("{src}/{id}.ts", "cookies().set('theme', theme);\ncookies().set('sid', v, { httpOnly: true });"),
        ("{src}/{id}.tsx", "'use client';\nconst key = process.env.SUPABASE_SERVICE_ROLE_KEY;"),
        ("{src}/{id}.tsx", '"use client";\nconst c = createClient(\n  url,\n  process.env.MY_SERVICE_ROLE\n);'),
        ("{src}/{id}.ts", "await supabase.auth.admin.deleteUser(id);"),
        ("{src}/{id}.ts", "await stripe.refunds.create({ charge: c });\n"
                          "await stripe.charges.create({ a: 1 }, { idempotencyKey: k });"),
        ("{src}/lib/clerk-webhook-{id}.ts", "// clerk events\nconst evt = await request.json();"),
        ("{src}/{id}.js", "jwt.sign(claims(user), 'changeme')"),
        ("{src}/{id}.js", "store.cookies.set('a', b);  // eval(x)\n// eval(commented)"),
        ("{src}/{id}.js", "exec(a(b(c(d(e(1))))), req.query.x);\nexec('the input');"),
        ("{src}/{id}.js", 'exec("echo ) " + req.query.x);'),
        ("{src}/{id}.ts", "cookies().set('s', f(g(h(i(j(1))))), { httpOnly: true });\n"
                          "cookies().set('s', ':(', { httpOnly: true });\ncookies().set('deep', f(g(h(i(j(1))))));"),
        ("{src}/{id}.ts", 'stripe.charges.create({ description: "a) b" }, { idempotencyKey: k });\n'
                          'stripe.charges.create({ description: "a) b" });'),
        ("{src}/{id}.js", "cors({ f: a(b(c(d(1)))), origin: '*' });"),
        ("{src}/{id}.js", "jwt.sign({ a: { b: 1 } }, 'short');\njwt.sign(make(user, 1), 'tiny');"),
    ],
    [  # python
        ("{src}/{id}.py", "requests.get(u, verify=False)  # pinned later"),
        ("{src}/{id}.py", "subprocess.run(request.args['c'], shell=True)"),
        ("{src}/{id}.py", "os.system('ls ' + request.args['d'])"),
        ("{src}/{id}.py", "cursor.execute(f'select * from t where id = {id}')"),
        ("{src}/conf{id}/settings.py", "DEBUG = True"),
        ("{src}/{id}.py", "SECRET_KEY = 'k-{h8}'"),
        ("{src}/{id}.py", "cfg = yaml.load(handle)"),
        ("{src}/{id}.py", "obj = pickle.loads(payload)"),
        ("{src}/{id}.py", "value = eval(request.args['x'])"),
        ("{src}/{id}.py", "@app.route('/items')\ndef items(): pass"),
    ],
    [  # ruby
        ("{src}/{id}.rb", "skip_before_action :verify_authenticity_token"),
        ("{src}/{id}.rb", "out = `ls #{params[:dir]}`"),
        ("{src}/{id}.rb", 'User.where("email = #{params[:email]}")'),
        ("{src}/{id}.rb", "obj = Marshal.load(params[:blob])"),
        ("{src}/{id}.rb", "class ItemsController\n  Item.create"),
        ("{src}/{id}.rb", "system('make') # skip_before_action :verify_authenticity_token"),
    ],
    [  # go
        ("{src}/{id}.go", "db.Query(fmt.Sprintf(q, id)) // later"),
        ("{src}/{id}.go", 'exec.Command("sh", r.FormValue("c"))'),
        ("{src}/{id}.go", "cfg := tls.Config{InsecureSkipVerify: true}"),
        ("{src}/{id}.go", 'http.HandleFunc("/api/items", handler)'),
    ],
    [  # php
        ("{src}/{id}.php", 'eval($_GET["c"]);'),
        ("{src}/{id}.php", "mysqli_query(\"select * from t where id = $_GET[id]\");"),
        ("{src}/{id}.php", 'system($_POST["cmd"]);'),
        ("{src}/{id}.php", 'unserialize($_COOKIE["s"]);'),
        ("{src}/{id}.php", 'include($_GET["page"]);'),
    ],
    [  # sql
        ("{src}/{id}.sql", "grant select on t to anon;"),
        ("{src}/{id}.sql", "alter table t{id} disable row level security;"),
        ("{src}/{id}.sql", "-- grant all on t to public"),
    ],
    [  # environment files
        ("{src}/{id}/.env", "NEXT_PUBLIC_API_KEY={h12}"),
        ("{src}/{id}/.env", "VITE_TOKEN = {h12}\n# PUBLIC_SECRET=1"),
        ("{src}/{id}/.env.local", "STRIPE_KEY=sk_live_{h24}"),
    ],
    [  # other text
        ("{src}/{id}.txt", "key AKIA{H16}"),
        ("{src}/{id}.txt", "rk_test_{h24} and sk_live_{h24}"),
        ("{src}/{id}.txt", "xoxb-{h24}"),
        ("{src}/{id}.txt", "sk-proj-{h24}"),
        ("{src}/{id}.txt", "SG.{h20}.{h20}"),
        ("{src}/{id}.txt", "account AC{h32}"),
        ("{src}/{id}.txt", "re_{h20}"),
        ("{src}/{id}.txt", "eyJ{h12}.{h12}.{h12}"),
        ("{src}/{id}.txt", "github_pat_{h24} password: {h12}"),
    ],
]


# What the call rules must report of the planted texts, as (rule, first line of the call, shown): the SQL checks hold the rules to
# these rows, not to their patterns. % stands for hashed text, which shown takes from between double quotes as {text}.
EXPECTED_CALLS = [
    ("auth.weak_jwt_secret", 'const t = jwt.sign({ id: 7 }, "short-%", opts);', "jwt.sign(..., '{text}', ...)"),
    ("auth.weak_jwt_secret", "jwt.sign(claims(user), 'changeme')", "jwt.sign(..., 'changeme', ...)"),
    ("auth.weak_jwt_secret", "jwt.sign({ a: { b: 1 } }, 'short');", "jwt.sign(..., 'short', ...)"),
    ("auth.weak_jwt_secret", "jwt.sign(make(user, 1), 'tiny');", "jwt.sign(..., 'tiny', ...)"),
    ("injection.shell_command", "child_process.exec(`ls ${req.query.dir}`);", "child_process.exec(<user-input>)"),
    ("injection.shell_command", "exec(a(b(c(d(e(1))))), req.query.x);", "exec(<user-input>)"),
    ("injection.shell_command", 'exec("echo ) " + req.query.x);', "exec(<user-input>)"),
    ("logic.mass_assignment", "prisma.user.update({", "prisma.user.update({ data: body })"),
    ("infra.open_cors", "app.use(cors({", "cors({ origin: '*' })"),
    ("infra.open_cors", "cors({ f: a(b(c(d(1)))), origin: '*' });", "cors({ origin: '*' })"),
    ("nextjs.cookies_missing_options", "cookies().set('theme', theme);", "cookies.set(...) missing { httpOnly, secure, sameSite }"),
    ("nextjs.cookies_missing_options", "cookies().set('deep', f(g(h(i(j(1))))));", "cookies.set(...) missing { httpOnly, secure, sameSite }"),
    ("nextjs.cookies_missing_options", "store.cookies.set('a', b);  // eval(x)", "store.cookies.set(...) missing { httpOnly, secure, sameSite }"),
    ("supabase.service_role_in_client_bundle", "const c = createClient(", "createClient(url, process.env.MY_SERVICE_ROLE)"),
    ("stripe.idempotency_missing", "await stripe.refunds.create({ charge: c });", "stripe.refunds.create(...) without { idempotencyKey: ... }"),
    ("stripe.idempotency_missing", 'stripe.charges.create({ description: "a) b" });', "stripe.charges.create(...) without { idempotencyKey: ... }"),
]


def hash_names(id_column) -> dict:
    digest = F.md5(id_column.cast("string").cast("binary"))
    return {
        "id": id_column.cast("string"),
        "h8": F.substring(digest, 1, 8), "h12": F.substring(digest, 1, 12), "h20": F.substring(digest, 1, 20),
        "h24": F.substring(digest, 1, 24), "h32": digest, "H16": F.upper(F.substring(digest, 1, 16)),
    }


def hash_names_sql(id_sql: str) -> dict[str, str]:
    digest = f"md5(CAST({id_sql} AS VARCHAR))"
    return {
        "id": f"CAST({id_sql} AS VARCHAR)",
        "h8": f"substr({digest}, 1, 8)", "h12": f"substr({digest}, 1, 12)", "h20": f"substr({digest}, 1, 20)",
        "h24": f"substr({digest}, 1, 24)", "h32": digest, "H16": f"upper(substr({digest}, 1, 16))",
    }


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrivals(rows: DataFrame, number, count: int, place: str) -> Iterator[None]:
    """Rows come to ``place/in`` in ``count`` arrivals, told by a number column; a stream run after each takes it up before the next.

    An arrival is as many files as its tasks write, so none of them goes through one task.
    """
    numbered = rows.withColumn("_arrival", number.cast("int"))
    numbered.write.partitionBy("_arrival").parquet(f"{place}/all")
    for n in range(count):
        arrived = rows.sparkSession.read.schema(numbered.schema).parquet(f"{place}/all").where(F.col("_arrival") == n)
        arrived.drop("_arrival").write.mode("append").parquet(f"{place}/in")
        yield


def _pick(kind, entry, which: int):
    """The template of an id: a constant table of texts, indexed twice."""
    tables = F.expr("array(" + ", ".join(
        "array(" + ", ".join(literal(e[which]) for e in entries) + ")" for entries in PLANTED) + ")")
    mine = F.element_at(tables, (kind + 1).cast("int"))
    return F.element_at(mine, (F.pmod(entry, F.size(mine)) + 1).cast("int"))


def fill(template, names: dict):
    """Replace ``{name}`` in a template column."""
    for name, value in names.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def derived_files(spark: SparkSession, sf_dir: str, version: int = 0) -> DataFrame:
    """(doc_id, repo_id, path, content, size): every document as one source file.

    Version 1 is a later state of the same repositories: half of the file kinds
    hold another flaw.
    """
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    names = {**hash_names(F.col("doc_id")), "src": F.col("source")}
    kind, entry = F.pmod("doc_id", F.lit(8)), F.floor((F.col("doc_id") + 4 * version) / 8)
    return documents.select(
        "doc_id", F.col("source").alias("repo_id"), fill(_pick(kind, entry, 0), names).alias("path"),
        F.concat(F.col("text"), F.lit("\n"), fill(_pick(kind, entry, 1), names)).alias("content"),
    ).withColumn("size", F.octet_length("content").cast("long"))


def derived_files_sql(version: int = 0) -> str:
    """The same table as a SELECT for the SQL checks."""
    names = {**hash_names_sql("doc_id"), "src": "source"}
    entry = f"CAST(floor((doc_id + {4 * version}) / 8) AS BIGINT)"
    path = " ".join(
        f"WHEN {k} THEN {pick_sql(f'({entry} % {len(e)})', [p for p, _ in e], names)}" for k, e in enumerate(PLANTED)
    )
    planted = " ".join(
        f"WHEN {k} THEN {pick_sql(f'({entry} % {len(e)})', [t for _, t in e], names)}" for k, e in enumerate(PLANTED)
    )
    return f"""SELECT doc_id, repo_id, path, content, CAST(strlen(content) AS BIGINT) AS size FROM (
        SELECT doc_id, source AS repo_id, CASE doc_id % 8 {path} END AS path,
               text || chr(10) || CASE doc_id % 8 {planted} END AS content FROM documents)"""


# Ignore files, one per repository; entry = number of the source % length.
IGNORE_TEXTS = [
    "# reviewed\n\nrule:secrets.stripe_live {src}/*.txt\npath:{src}/1*.rb\n",
    "rule:* {src}/*1.go\n{src}/?.py\n",
    "path: {src}/conf*/**\nrule:php.sql_injection\n",
    "rule:db.public_grant {src}/?*.sql\nrule:db.public_grant {src}/**\nfinding: 0123456789abcdef\n",
]


def source_number(source):
    return F.substr(source, F.lit(4)).cast("int")


def derived_ignore_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo_id, path, content, size): the ignore file of every repository."""
    sources = table(spark, sf_dir, "documents").select("source").distinct()
    text = F.element_at(F.array(*[F.lit(t) for t in IGNORE_TEXTS]), source_number(F.col("source")) % 4 + 1)
    return sources.select(
        F.col("source").alias("repo_id"), F.concat("source", F.lit("/.scanignore")).alias("path"),
        F.replace(text, F.lit("{src}"), F.col("source")).alias("content"),
    ).withColumn("size", F.octet_length("content").cast("long"))


def derived_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files and ignore files of every repository."""
    return derived_files(spark, sf_dir).drop("doc_id").unionByName(derived_ignore_files(spark, sf_dir))


def derived_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo_id, org_id, target)."""
    sources = table(spark, sf_dir, "documents").select(F.col("source").alias("repo_id")).distinct()
    org = F.concat(F.lit("org"), (source_number(F.col("repo_id")) % 3).cast("string"))
    return sources.select("repo_id", org.alias("org_id"), F.col("repo_id").alias("target"))


REPOSITORIES_SQL = ("SELECT DISTINCT source AS repo_id, 'org' || CAST(CAST(substr(source, 4) AS INTEGER) % 3 AS VARCHAR) AS org_id, "
                    "source AS target FROM documents")


def derived_suppressions(findings: DataFrame) -> DataFrame:
    """Workspace rules about findings whose id starts with 0..2, some of them twice."""
    def digit(n: int):
        return F.conv(F.substr("id", F.lit(n), F.lit(1)), 16, 10).cast("int")

    org = F.concat(F.lit("org"), (source_number(F.col("repo_id")) % 3).cast("string"))
    base = findings.where(digit(1) <= 2).select(
        F.concat(F.lit("s"), "id").alias("sid"), org.alias("org_id"), F.col("id").alias("finding_id"),
        F.when(digit(2) == 15, "elsewhere").when(digit(2) == 14, "").when(digit(2) < 8, "*").otherwise(F.col("repo_id")).alias("target"),
        F.when(digit(3) < 6, "").otherwise(F.concat(F.lit("because "), F.substr("id", F.lit(3), F.lit(2)))).alias("reason"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), digit(4))).alias("created_at"), digit(3).alias("d3"),
    )
    again = base.where("d3 >= 10").select(
        F.concat(F.lit("t"), "sid").alias("sid"), "org_id", "finding_id", F.lit("*").alias("target"),
        F.lit("second look").alias("reason"), (F.col("created_at") + F.expr("INTERVAL 1 DAY")).alias("created_at"), "d3")
    return base.unionByName(again).withColumnRenamed("sid", "id").withColumn("created_by", F.lit("u1")).drop("d3")


def _digit_sql(n: int) -> str:
    return f"(strpos('0123456789abcdef', substr(id, {n}, 1)) - 1)"


SUPPRESSION_CTES = f""",
    picked AS (SELECT 's' || id AS sid, 'org' || CAST(CAST(substr(repo_id, 4) AS INTEGER) % 3 AS VARCHAR) AS org_id, id AS finding_id,
        CASE WHEN {_digit_sql(2)} = 15 THEN 'elsewhere' WHEN {_digit_sql(2)} = 14 THEN '' WHEN {_digit_sql(2)} < 8 THEN '*' ELSE repo_id END AS target,
        CASE WHEN {_digit_sql(3)} < 6 THEN '' ELSE 'because ' || substr(id, 3, 2) END AS reason,
        TIMESTAMP '2024-01-01' + to_hours(CAST({_digit_sql(4)} AS INTEGER)) AS created_at, {_digit_sql(3)} AS d3
      FROM findings WHERE {_digit_sql(1)} <= 2),
    suppressions AS (SELECT sid, org_id, finding_id, target, reason, created_at FROM picked
      UNION ALL SELECT 't' || sid, org_id, finding_id, '*', 'second look', created_at + INTERVAL 1 DAY FROM picked WHERE d3 >= 10),
    repositories AS ({REPOSITORIES_SQL})"""


def _ignore_text_sql() -> str:
    return pick_sql("CAST(substr(source, 4) AS INTEGER) % 4", IGNORE_TEXTS, {"src": "source"})


IGNORE_FILES_SQL = (f"SELECT source AS repo_id, source || '/.scanignore' AS path, {_ignore_text_sql()} AS content "
                    "FROM (SELECT DISTINCT source FROM documents)")
PROJECT_FILES_SQL = (f"SELECT repo_id, path, content, size FROM ({derived_files_sql()}) UNION ALL "
                     f"SELECT repo_id, path, content, CAST(strlen(content) AS BIGINT) FROM ({IGNORE_FILES_SQL})")

# What the ignore texts say, written out: (source number % 4, line, kind, rule, pattern of the glob in RE2, finding).
IGNORE_MEANING = r"""(VALUES (0, 3, 'rule', 'secrets.stripe_live', '^{src}/[^/]*\.txt$', NULL), (0, 4, 'path', NULL, '^{src}/1[^/]*\.rb$', NULL),
    (1, 1, 'rule', '*', '^{src}/[^/]*1\.go$', NULL), (1, 2, 'path', NULL, '^{src}/[^/]\.py$', NULL),
    (2, 1, 'path', NULL, '^{src}/conf[^/]*/.*$', NULL), (2, 2, 'rule', 'php.sql_injection', '^.*/[^/]*$', NULL),
    (3, 1, 'rule', 'db.public_grant', '^{src}/[^/][^/]*\.sql$', NULL), (3, 2, 'rule', 'db.public_grant', '^{src}/.*$', NULL),
    (3, 3, 'finding', NULL, NULL, '0123456789abcdef'))"""
IGNORE_RULES_SQL = f"""SELECT s.source AS repo_id, v.line, v.kind, v.rule, replace(v.pattern, '{{src}}', s.source) AS pattern, v.finding_id
    FROM (SELECT DISTINCT source FROM documents) s JOIN {IGNORE_MEANING} v(n, line, kind, rule, pattern, finding_id)
      ON CAST(substr(s.source, 4) AS INTEGER) % 4 = v.n"""
