"""Ignore files, suppressions, budgets, dependencies, migrations, sites."""

import base64
import json
import random

import pytest
from pyspark.sql import functions as F

from lintlake.operators import budget, bundle, dependencies, migrations, suppress
from lintlake.operators.joins import join_lookup
from lintlake.operators.reachability import label_propagation
from lintlake.session import settle


# ------------------------------------------------------------------- ignore
@pytest.mark.parametrize("glob, path, hit", [
    ("**/*", "a/b.js", True), ("**/*", "b.js", False), ("src/*.js", "src/a.js", True), ("src/*.js", "src/x/a.js", False),
    ("src/**", "src/x/a.js", True), ("a?.js", "ab.js", True), ("a?.js", "a/.js", False), ("a+b(1).js", "a+b(1).js", True),
    ("[x].js", "[x].js", True), ("[x].js", "x.js", False), ("a.js", "aXjs", False), ("a.js", "a.js\n", False),
])
def test_glob(spark, glob, path, hit):
    row = spark.createDataFrame([(glob, path)], "glob string, path string").select(
        (F.regexp_instr("path", suppress.glob_to_regex(F.col("glob"))) > 0).alias("hit")).first()
    assert row["hit"] is hit


def test_first_ignore_file_wins_and_text_is_parsed(files_of):
    text = "# c\n\n rule:a.b  src/* x \nrule:c.d\npath: lib/*\nfinding: abc\nplain/**\n"
    files = files_of([("deep/.scanignore", "path:no"), (".scanignore", text)])
    rules = suppress.ignore_rules(suppress.ignore_files(files)).orderBy("line").collect()
    assert [(r["kind"], r["rule"], r["glob"], r["finding_id"]) for r in rules] == [
        ("rule", "a.b", "src/* x", None), ("rule", "c.d", "**/*", None), ("path", None, "lib/*", None),
        ("finding", None, None, "abc"), ("path", None, "plain/**", None)]


def test_org_suppression_order_limit_and_reason(spark):
    findings = spark.createDataFrame(
        [("r", "f1", "x", "a/1", 1, "o", "app"), ("r", "f2", "x", "a/2", 1, "o", "app"), ("r", "f3", "x", "3", 1, "o", "app"),
         ("r", "f4", "x", "a/4", 1, "p", "")],
        "repo_id string, id string, rule string, file string, line int, org_id string, target string")
    rows = [("1", "o", "f1", "*", "old", "2024-01-01"), ("2", "o", "f1", "app", "", "2024-01-03"), ("3", "o", "f1", "other", "no", "2024-01-04"),
            ("4", "o", "f2", "app", "kept", "2024-01-02"), ("5", "p", "f4", "elsewhere", "any", "2024-01-01")]
    own = spark.createDataFrame(rows, "id string, org_id string, finding_id string, target string, reason string, at string").select(
        "*", F.col("at").cast("timestamp").alias("created_at"))
    rules = spark.createDataFrame([("r", "rule", "x", "**/*", None)], "repo_id string, kind string, rule string, glob string, finding_id string")
    rules = rules.withColumn("regex", suppress.glob_to_regex(F.col("glob")))
    got = {r["id"]: (r["suppressed"], r["suppression_reason"]) for r in suppress.apply_suppressions(findings, rules.where("false"), own).collect()}
    # f1: the newest match has an empty reason, so the ignore-file reason shows.
    assert got == {"f1": (True, "matched ignore file"), "f2": (True, "kept"), "f3": (False, None), "f4": (True, "any")}
    # The default glob does not reach files at the root.
    got = {r["id"]: r["suppressed"] for r in suppress.apply_suppressions(findings, rules, own.where("false")).collect()}
    assert got == {"f1": True, "f2": True, "f3": False, "f4": True}
    # Only the newest rules of a workspace count.
    got = {r["id"]: r["suppressed"] for r in suppress.apply_suppressions(findings, rules.where("false"), own, limit=2).collect()}
    assert got == {"f1": True, "f2": False, "f3": False, "f4": True}


# ------------------------------------------------------------------- budget
def brute(rows, max_files, max_bytes, mode):
    out = set()
    for repo in {r[0] for r in rows}:
        total = count = 0
        for path, size in sorted((p, s) for r, p, s in rows if r == repo):
            if count >= max_files:
                break
            if total + size > max_bytes:
                if mode == "stop":
                    break
                continue
            out.add((repo, path))
            total, count = total + size, count + 1
    return out


@pytest.mark.parametrize("seed", range(2))
def test_budgets_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(f"r{rng.randint(0, 2)}", f"{i:04d}", rng.choice([0, 1, 5, 20, 90, 90, 400])) for i in range(400)]
    rows = [(r, f"{rng.random():.6f}", s) for r, _, s in rows]
    files = spark.createDataFrame(rows, "repo_id string, path string, size long")
    for max_files, max_bytes in ((15, 500), (60, 900), (3, 10_000)):
        skip = {(r["repo_id"], r["path"]) for r in budget.file_budget_skip(files, max_files, max_bytes).collect()}
        stop = {(r["repo_id"], r["path"]) for r in budget.file_budget_stop(files, max_files, max_bytes).collect()}
        assert skip == brute(rows, max_files, max_bytes, "skip")
        assert stop == brute(rows, max_files, max_bytes, "stop")


def test_budget_of_a_repository_in_many_ranges(spark):
    rng = random.Random(5)
    # Large and tiny files in turn: what is left shrinks in many ranges.
    rows = [("hot", f"{i:04d}", rng.choice([1, 2, 900 - i, 450 - i // 2]) if i < 500 else rng.randint(0, 3)) for i in range(700)]
    rows += [(f"k{i % 3}", f"{i:04d}", rng.randint(0, 30)) for i in range(60)] + [("none", "a", 5000)]
    odd = [(None, "a", 1), ("k0", "zz", None)]
    files = spark.createDataFrame(rows + odd, "repo_id string, path string, size long").repartition(7)
    for max_files, max_bytes in ((80, 1000), (1000, 3000), (1000, 1 << 30), (1, 10)):
        got = sorted((r["repo_id"], r["path"]) for r in budget.file_budget_skip(files, max_files, max_bytes, 12).collect())
        assert got == sorted(brute(rows, max_files, max_bytes, "skip"))
    assert budget.file_budget_skip(files.limit(0), 5, 5).count() == 0


# ------------------------------------------------------------- dependencies
def test_manifests(files_of):
    files = files_of([
        ("Gemfile.lock", "GIT\n    x (1.0)\n\nGEM\n  specs:\n    RedCloth (4.3.2)\n    rack (3.0, >= 1)\n\nGEM\n    again (2.0)\n\nPLATFORMS\n    no (1.0)\n"),
        ("go.mod", "module m\nrequire one/x v9.9.9\nrequire (\n\ta.b/c v1.2.3 // x\n)\nrequire (\n\td.e/f v2.0.0\n)\n"),
        ("sub/requirements.txt", "a==1.0\nb >= 2\nc_d == 2.0+x # y\n#e==1\n"),
        ("package.json", "not json"), ("x/package.json", json.dumps({"dependencies": {"a": "^1.2.3", "b": "workspace:*", "c": "latest"}, "optionalDependencies": {"o": ">=2.0 <3"}})),
        ("package-lock.json", json.dumps({"packages": {"": {"version": "1"}, "node_modules/@s/p": {"version": "1.0.0"}, "node_modules/a/node_modules/b": {"version": "2.0.0"}, "node_modules/z": {}}})),
        ("yarn.lock", "a@1:\n  version 1\n")])
    got = {(r["path"], r["ecosystem"], r["name"], r["version"]) for r in dependencies.dependency_inventory(files).collect()}
    assert got == {
        ("Gemfile.lock", "RubyGems", "RedCloth", "4.3.2"), ("Gemfile.lock", "RubyGems", "rack", "3.0, >= 1"), ("Gemfile.lock", "RubyGems", "again", "2.0"),
        ("go.mod", "Go", "a.b/c", "1.2.3"), ("sub/requirements.txt", "PyPI", "a", "1.0"), ("sub/requirements.txt", "PyPI", "c_d", "2.0+x"),
        ("x/package.json", "npm", "a", "1.2.3"), ("x/package.json", "npm", "o", "2.0"),
        ("package-lock.json", "npm", "@s/p", "1.0.0"), ("package-lock.json", "npm", "b", "2.0.0")}


def test_entries_per_manifest(files_of):
    files = files_of([("requirements.txt", "\n".join(f"p{i:03d}==1.0" for i in range(130)))])
    inventory = dependencies.dependency_inventory(files)
    names = lambda limit: [r["name"] for r in dependencies.distinct_dependencies(inventory, limit).orderBy("pos").collect()]
    assert names(None) == [f"p{i:03d}" for i in range(130)]
    assert names(dependencies.SERVICE_LIMITS["per_manifest"]) == [f"p{i:03d}" for i in range(100)]


def test_every_advisory_is_reported(spark, files_of):
    files = files_of([("requirements.txt", "bad==1.0\n")])
    vuln = "named_struct('id', concat('V', i), 'summary', repeat('s', 200), 'severity', CAST(NULL AS array<struct<type:string,score:string>>), 'db_severity', array('HIGH'), 'references', transform(sequence(1, 5), x -> concat('u', x)), 'has_ranges', false)"
    advisories = spark.sql(f"SELECT 'PyPI' ecosystem, 'bad' package_name, '1.0' version, collect_list({vuln}) vulns, timestamp '2099-01-01' expires_at FROM (SELECT explode(sequence(1, 7)) i)")
    inventory = dependencies.dependency_inventory(files)
    now = F.current_timestamp()
    rows = dependencies.dependency_advisories(inventory, advisories, now).collect()
    assert len(rows) == 7 and all(len(r["references"]) == 5 and r["title"].endswith("s" * 200) for r in rows)
    cut = dependencies.dependency_advisories(inventory, advisories, now, **dependencies.SERVICE_LIMITS).collect()
    assert len(cut) == 3 and all(len(r["references"]) == 3 and not r["title"].endswith("s" * 161) for r in cut)


# --------------------------------------------------------------- migrations
def rules_of(files):
    return sorted((r["rule"], r["file"], r["line"], r["severity"]) for r in migrations.lint_migrations(files).collect())


def test_statements_keep_their_lines(files_of):
    text = ("comment on schema app is 'x; -- y';\n\n-- old; note\ndo $do$ declare n int; begin n := 2; end $do$;\n"
            "/* kept; for\nlater */\nupdate app.pets set name = 'O''Neil; jr'\n where id = 4")
    rows = migrations.sql_statements(files_of([("1.sql", text)])).orderBy("seq").collect()
    assert [r["line"] for r in rows] == [1, 4, 7]
    assert rows[1]["text"].startswith("do $do$ declare") and rows[2]["text"] == "update app.pets set name = 'O''Neil; jr' where id = 4"


def test_policy_clauses_follow_the_table(files_of):
    text = """create policy "read using (true) rows" on pets for update to anon with check (auth.uid() = keeper);
create policy "with check (true)" on pets for insert to authenticated with check (keeper = auth.uid());"""
    rows = migrations.sql_statements(files_of([("1.sql", text)])).orderBy("seq").collect()
    assert [(r["using_expr"], r["check_expr"]) for r in rows] == [(None, "auth.uid() = keeper"), (None, "keeper = auth.uid()")]
    assert rules_of(files_of([("supabase/1.sql", text)])) == []


def test_lint_needs_a_flagged_project(files_of):
    assert rules_of(files_of([("db/schema.sql", "create table users (id int);")])) == []
    package = ("package.json", '{"dependencies":{"@supabase/supabase-js":"2.0.0"}}')
    assert rules_of(files_of([package, ("db/schema.sql", "create table a (id int);")])) == [
        ("supabase.rls_not_enabled", "db/schema.sql", 1, "critical")]


def test_lint_sees_all_files_of_a_project(files_of):
    files = [("supabase/migrations/1.sql", 'CREATE TABLE "Pets" (id int);\ncreate table vault.logs (id int);'),
             ("supabase/migrations/2.sql", "ALTER TABLE ONLY public.pets ENABLE ROW LEVEL SECURITY;")]
    assert rules_of(files_of(files)) == []
    # Another repository's statement does not count.
    other = files_of(files[1:], repo="other").unionByName(files_of(files[:1]))
    assert rules_of(other) == [("supabase.rls_not_enabled", "supabase/migrations/1.sql", 1, "critical")]


def test_lint_policies_views_functions(files_of):
    text = """create table pets (id int);
alter table pets force row level security;
create policy "walk in" on pets for insert to anon with check (true);
create policy "keeper edits" on pets for update to authenticated using (keeper = auth.uid());
create policy "never" on pets as restrictive for delete using (false);
create policy "tagged" on pets for delete to authenticated using (tag is not null);
create policy shown on pets for select using ((true));
create or replace view public.cats as select 2;
create view public.dogs with (security_invoker = true) as select 2;
create materialized view birds as select 2;
create function public.feed() returns int language sql security definer as $q$ select 2; $q$;
create function public.wash() returns int language sql security definer set search_path = '' as $q$ select 2; $q$;
create table pets (id int, age int);"""
    assert [(r, n, s) for r, _, n, s in rules_of(files_of([("supabase/1.sql", text)]))] == [
        ("supabase.rls_policy_not_user_scoped", 6, "high"), ("supabase.rls_policy_public_read", 7, "medium"),
        ("supabase.rls_policy_write_true", 3, "critical"), ("supabase.security_definer_search_path", 11, "medium"),
        ("supabase.view_bypasses_rls", 8, "high")]


# --------------------------------------------------------------------- site
def token(role):
    part = lambda o: base64.urlsafe_b64encode(json.dumps(o).encode()).decode().rstrip("=")
    return ".".join([part({"alg": "HS256", "typ": "JWT"}), part({"ref": "abcdefgh", "role": role}), "c2lnbmF0dXJl"])


def test_site_scan(spark):
    stripe = "_".join(["sk", "live", "n0tArealKey" * 3])
    html = ('<html><body><script type="application/json">{"buildId":"r77"}</script><script defer src="/_next/static/chunks/one.js"></script>'
            '<link href="/_next/static/chunks/two.js" rel="modulepreload"><script src="https://other.example.net/count.js"></script></body></html>')
    site = "https://zoo.example.org"
    pages = spark.createDataFrame([(1, site + "/", html)], "page_id long, url string, html string")
    assets = spark.createDataFrame([
        (site + "/_next/static/chunks/one.js", 200, f'c("{token("anon")}");\n//# sourceMappingURL=one.js.map'),
        (site + "/_next/static/chunks/one.js.map", 200, "{}"),
        (site + "/_next/static/chunks/two.js", 200, f'f("{stripe}")'),
        (site + "/_next/static/r77/_buildManifest.js", 200, 'm={"/in":["static/chunks/back.js"]}'),
        (site + "/_next/static/chunks/back.js", 200, f'\nc("{token("service_role")}")'),
        ("https://other.example.net/count.js", 200, f'f("{stripe}")'),
    ], "url string, status int, body string")
    assert bundle.site_assets(pages, assets).count() == 4
    rows = bundle.scan_site(pages, assets).collect()
    assert sorted((r["rule"], r["file"], r["line"]) for r in rows) == [
        ("bundle.source_maps_public", "/_next/static/chunks/one.js", None), ("bundle.stripe_live", "/_next/static/chunks/two.js", 1),
        ("bundle.supabase_service_role", "/_next/static/chunks/back.js", 2)]
    assert any("project abcdefgh" in r["evidence"] for r in rows) and not any("n0tArealKey" in r["evidence"] for r in rows)


# ------------------------------------------------------------- reachability
def test_reachability_stays_in_scope_and_within_depth(spark):
    edges = spark.createDataFrame([("s", "a", "b"), ("s", "b", "c"), ("s", "c", "a"), ("s", "c", "d"), ("t", "d", "e")], "scope string, src string, dst string")
    sources = spark.createDataFrame([("s", "a")], "scope string, node string")
    sinks = spark.createDataFrame([(s, n, "x") for s in "st" for n in "abcde"], "scope string, node string, rule string")
    got = lambda depth: sorted((r["node"], r["depth"]) for r in label_propagation(edges, sources, sinks, depth).collect())
    assert got(8) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert got(2) == [("a", 0), ("b", 1), ("c", 2)]
    chain = spark.createDataFrame([("s", f"n{i}", f"n{i + 1}") for i in range(14)], "scope string, src string, dst string")
    end = spark.createDataFrame([("s", "n14", "x")], "scope string, node string, rule string")
    start = spark.createDataFrame([("s", "n0")], "scope string, node string")
    assert [r["depth"] for r in label_propagation(chain, start, end).collect()] == [14]


def fewest_hops(edges, sources, max_depth=None):
    depth, todo = {s: 0 for s in sources}, list(sources)
    following = {}
    for scope, src, dst in edges:
        following.setdefault((scope, src), []).append((scope, dst))
    for node in todo:
        for dst in following.get(node, ()):
            if dst not in depth and (max_depth is None or depth[node] < max_depth):
                depth[dst] = depth[node] + 1
                todo.append(dst)
    return {(*node, d) for node, d in depth.items()}


def reach(spark, edges, sources, max_depth=None):
    nodes = sorted({(s, n) for s, a, b in edges if a is not None and b is not None for n in (a, b)} | set(sources))
    got = label_propagation(
        spark.createDataFrame(edges, "scope string, src long, dst long"), spark.createDataFrame(sources, "scope string, node long"),
        spark.createDataFrame([(s, n, "x") for s, n in nodes], "scope string, node long, rule string"), max_depth)
    return sorted((r["scope"], r["node"], r["depth"]) for r in got.collect())


def test_reachability_equals_brute_force(spark, monkeypatch):
    from lintlake.operators import reachability

    monkeypatch.setattr(reachability, "SHALLOW", 1)
    monkeypatch.setattr(reachability, "HOPS", 2)
    rng = random.Random(1)
    chain = [("chain", i, i + 1) for i in range(60)] + [("chain", 60, 20), ("chain", 100, 50)]
    tree = [("tree", i // 2, i) for i in range(2, 120)] + [("tree", 1, 1)]
    diamonds = [("d", 3 * i + a, 3 * i + b) for i in range(12) for a, b in ((0, 1), (0, 2), (1, 3), (2, 3))] + [("d", 0, 30)]
    rings = [("ring", a, b) for a, b in ((0, 1), (1, 2), (2, 0), (10, 11), (11, 12), (12, 10), (12, 13), (13, 14), (14, 2))]
    mixed = [(f"m{rng.randint(0, 1)}", rng.randint(0, 80), rng.randint(0, 80)) for _ in range(150)]
    hub = [("hub", 0, i) for i in range(1, 90)] + [("hub", i, 200) for i in range(1, 90)] + [("hub", 200 + i, 201 + i) for i in range(9)]
    edges = chain + tree + diamonds + rings + mixed + hub
    sources = [("chain", 0), ("tree", 1), ("d", 0), ("ring", 0), ("m0", 3), ("m1", 5), ("m1", 6), ("hub", 0), ("none", 1)]
    for limit in (None, 7):
        got = reach(spark, edges + mixed[:20] + [("tree", None, 3), ("tree", 3, None)], sources, limit)
        assert got == sorted(fewest_hops(edges, sources, limit))


def test_a_long_chain_takes_few_jobs(spark, monkeypatch):
    from lintlake.operators import reachability

    settled, settle = [], reachability.settle
    monkeypatch.setattr(reachability, "SHALLOW", 2)
    monkeypatch.setattr(reachability, "settle", lambda df: settled.append(1) or settle(df))
    assert reach(spark, [("s", i, i + 1) for i in range(1500)], [("s", 0)]) == [("s", i, i) for i in range(1501)]
    assert len(settled) < 30


def test_a_job_walks_edges_into_unreached_nodes_only_and_sorts_none(spark, monkeypatch):
    from lintlake.operators import reachability

    settled, settle = [], reachability.settle

    def recorded(df):
        plan, table = df._jdf.queryExecution().executedPlan().toString(), settle(df)
        settled.append((table, plan))
        return table

    monkeypatch.setattr(reachability, "HOPS", 2)
    monkeypatch.setattr(reachability, "settle", recorded)
    # Layers of ten nodes; each node leads to all of the next layer and back to all of the one before.
    layers = [(i, j) for i in range(7) for j in (i - 1, i + 1) if 0 <= j < 7]
    edges = [("s", 10 * i + a, 10 * j + b) for i, j in layers for a in range(10) for b in range(10)]
    sources = [("s", a) for a in range(10)]
    assert reach(spark, edges, sources) == sorted(fewest_hops(edges, sources))
    left = [table.count() for table, _ in settled if "src" in table.columns]
    into = lambda depth: sum(dst // 10 > depth for _, _, dst in edges)
    assert left == [len(edges), into(2), into(4), into(6)]
    plans = [plan for table, plan in settled if "hop" in table.columns]
    assert plans and not any("Sort" in plan or "BroadcastHashJoin" in plan for plan in plans)


# ------------------------------------------------------- ordered computations
def test_running_totals_and_previous_values_of_a_hot_key(spark):
    from lintlake.operators.ordered import previous_value, running_totals

    rng = random.Random(9)
    rows = [("hot" if i % 3 else f"k{i % 9}", i, rng.randint(0, 50)) for i in range(2000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i long, v long")
    total, previous, seen = {}, {}, {}
    for k, i, v in sorted(rows, key=lambda r: r[1]):
        previous[i] = seen.get(k, (0, None))[1]
        seen[k] = (seen.get(k, (0, None))[0] + v, v)
        total[i] = seen[k][0]
    assert {r["i"]: r["t"] for r in running_totals(df, ["k"], ["i"], {"t": F.col("v")}).collect()} == total
    assert {r["i"]: r["p"] for r in previous_value(df, ["k"], ["i"], "v", "p").collect()} == previous


# -------------------------------------------------------------- whole scans
def test_whole_scan(spark, files_of):
    from lintlake.plans.scans import scan_repositories

    files = files_of([
        (".scanignore", "path:old/**\nrule:php.eval_user_input **/*\n"),
        ("old/a.py", "x = yaml.load(f)\n"), ("src/a.py", "x = yaml.load(f)\n"), ("src/b.php", 'eval($_GET["c"]);'),
        ("supabase/1.sql", "create table t (id int);"), ("old/2.sql", "alter table t enable row level security;"),
        ("requirements.txt", "bad==1.0\ngood==2.0\n"), ("old/requirements.txt", "bad==1.0\nworse==1.0\n"),
    ])
    repos = spark.createDataFrame([("r", "o", "acme/r")], "repo_id string, org_id string, target string")
    none = spark.createDataFrame([], "id string, org_id string, finding_id string, target string, reason string, created_at timestamp")
    vuln = "array(named_struct('id', 'V1', 'summary', 'S', 'severity', CAST(NULL AS array<struct<type:string,score:string>>), 'db_severity', array('HIGH'), 'references', array('u'), 'has_ranges', false))"
    advisories = spark.sql(f"SELECT 'PyPI' ecosystem, name package_name, '1.0' version, {vuln} vulns, timestamp '2099-01-01' expires_at FROM VALUES ('bad'), ('worse') v(name)")
    findings, summary = scan_repositories(files, repos, none, advisories)
    assert sorted((r["rule"], r["file"], r["suppressed"]) for r in findings.collect()) == [
        ("deps.cve.V1", "requirements.txt", False), ("php.eval_user_input", "src/b.php", True),
        ("py.yaml_unsafe_load", "src/a.py", False), ("supabase.rls_not_enabled", "supabase/1.sql", False)]
    row = summary.first()
    assert (row["files_scanned"], row["active_findings"], row["suppressed_findings"], row["ignore_rules_applied"], row["truncated"]) == (5, 3, 1, 2, False)
    assert row["score"] == 100 - 10 - 18 - 10
    more = files.select("repo_id", "path").union(spark.createDataFrame([("r", "not/read.py")], "repo_id string, path string"))
    assert scan_repositories(files, repos, none, candidates=more)[1].first()["truncated"]


def test_registered_scan_reads_every_file(spark):
    """sf0.01 holds 51 files of every repository, of which ignore files drop some."""
    from lintlake.operators.suppress import drop_ignored_files
    from lintlake.plans.derived import derived_project
    from lintlake.plans.finding_queries import project_rules, whole_scan

    sf_dir = "/root/testdata/sf0.01"
    kept = drop_ignored_files(derived_project(spark, sf_dir), project_rules(spark, sf_dir))
    wanted = {r["repo_id"]: (r["n"], r["b"], False) for r in kept.groupBy("repo_id").agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()}
    found = {r["repo_id"]: (r["files_scanned"], r["bytes_scanned"], r["truncated"]) for r in whole_scan(spark, sf_dir).collect()}
    assert found == wanted and sum(n for n, *_ in wanted.values()) > 20 * 40


def test_scan_within_a_budget_is_truncated(spark, files_of):
    from lintlake.operators.budget import file_budget_stop
    from lintlake.plans.scans import scan_repositories

    candidates = files_of([(f"src/{n}.py", "x = 1\n") for n in range(3)])
    repos = spark.createDataFrame([("r", "o", "acme/r")], "repo_id string, org_id string, target string")
    none = spark.createDataFrame([], "id string, org_id string, finding_id string, target string, reason string, created_at timestamp")
    for limit in (2, 3):
        files = file_budget_stop(candidates, limit, 1 << 20).select(*candidates.columns)
        row = scan_repositories(files, repos, none, candidates=candidates.select("repo_id", "path"))[1].first()
        assert (row["files_scanned"], row["truncated"]) == (limit, limit < 3)


def test_nothing_is_cut(spark, files_of):
    """Inputs past the limits of the hosted service."""
    from lintlake.operators.suppress import match_org_suppressions

    site = "https://zoo.example.org"
    html = "".join(f'<script src="/s{i:03d}.js"></script>' for i in range(95))
    pages = spark.createDataFrame([(1, site + "/", html)], "page_id long, url string, html string")
    assets = spark.createDataFrame(
        [(f"{site}/s{i:03d}.js", 200, f"x({i});\n//# sourceMappingURL=s{i:03d}.js.map") for i in range(95)]
        + [(f"{site}/s{i:03d}.js.map", 200, "{}") for i in range(95)], "url string, status int, body string")
    assert bundle.site_assets(pages, assets).count() == 95 and bundle.site_assets(pages, assets, max_scripts=80).count() == 80
    assert "95 found" in bundle.scan_site(pages, assets).first()["title"]
    assert "10 found" in bundle.scan_site(pages, assets, **bundle.SERVICE_LIMITS).first()["title"]
    findings = spark.createDataFrame([("r", "f0", "a.py", 1, "o", "t")], "repo_id string, id string, file string, line int, org_id string, target string")
    rules = spark.sql("SELECT CAST(i AS STRING) id, 'o' org_id, concat('f', i) finding_id, '*' target, 'why' reason, timestamp_seconds(i) created_at FROM (SELECT explode(sequence(0, 600)) i)")
    assert match_org_suppressions(findings, rules).first()["ignored_by_org"]
    assert not match_org_suppressions(findings, rules, limit=500).first()["ignored_by_org"]



def test_lookup_in_compressed_files_is_not_broadcast_by_their_size(spark):
    rows = spark.range(40_000).selectExpr("concat('https://zoo.example.org/', id) AS url", "repeat('x', 300) AS chunks")
    lookup = settle(rows)  # 1 MB of files, 200 MB once it is repeated
    facts = spark.range(1_000_000).selectExpr("concat('https://zoo.example.org/', id) AS url", "id AS page_id")
    joined = join_lookup(facts, lookup, ["url"], ["page_id"], "inner")
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 40_000


def test_rows_of_one_url_are_one_site(spark):
    site = "https://zoo.example.org"
    html = '<html><script src="/a.js"></script>{}</html>'
    pages = spark.createDataFrame([(1, site + "/", html.format("")), (2, site + "/", html.format('<script src="/b.js"></script>'))],
                                  "page_id long, url string, html string")
    assets = spark.createDataFrame(
        [(f"{site}/{n}.js", 200, f"x;\n//# sourceMappingURL={n}.js.map") for n in "ab"] + [(f"{site}/{n}.js.map", 200, "{}") for n in "ab"],
        "url string, status int, body string")
    (row,) = bundle.scan_site(pages, assets).collect()
    assert "(2 found)" in row["title"] and row["evidence"] == "/a.js.map, /b.js.map"
