"""Migration lint: SQL statements of all migrations of a project, checked together.

Splitting a file into statements is the one Python step; it streams Arrow
batches of files and yields statement rows. Everything after it is relational,
across all files of a repository.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions.findings import assemble_findings
from lintlake.operators.joins import join_lookup
from lintlake.session import settle

# Statement shapes and what makes a policy user scoped.
PROJECT_SQL_PATH = r"(?i)(^|/)supabase/.+\.sql$"
PACKAGE_SCOPE = "@supabase/"
IDENT = r'((?:"[^"]+"|[\w$]+)(?:\s*\.\s*(?:"[^"]+"|[\w$]+))?)'
STATEMENT_KINDS = [
    ("table", r"(?i)^create\s+(?:unlogged\s+)?table\s+(?:if\s+not\s+exists\s+)?" + IDENT),
    ("enable", r"(?i)^alter\s+table\s+(?:if\s+exists\s+)?(?:only\s+)?" + IDENT
     + r"\s+(?:enable|force)\s+row\s+level\s+security"),
    ("policy", r'(?i)^create\s+policy\s+(?:"[^"]+"|\S+)\s+on\s+' + IDENT),
    ("view", r"(?i)^create\s+(?:or\s+replace\s+)?(?:materialized\s+)?view\s+(?:if\s+not\s+exists\s+)?" + IDENT),
    ("function", r"(?i)^create\s+(?:or\s+replace\s+)?function\s+" + IDENT),
]
POLICY_NAME = r'(?i)^create\s+policy\s+("[^"]+"|\S+)\s+on\s+'
POLICY_REST = r'(?i)^create\s+policy\s+(?:"[^"]+"|\S+)\s+on\s+' + IDENT + r"(.*)$"
POLICY_COMMAND = r"(?i)(?<!\w)for\s+(all|select|insert|update|delete)(?!\w)"
POLICY_ROLES = r'(?i)(?<!\w)to\s+([\w",\s]+?)(?=\s+(?:using|with\s+check)(?!\w)|$)'
USER_SCOPE = r"(?i)(?<!\w)auth\.(uid|jwt|role)\s*\(|(?<!\w)current_user(?!\w)|(?<!\w)requesting_user_id\s*\("
ALWAYS_TRUE = r"(?i)^\(*\s*true\s*\)*$"
DOCS = "https://supabase.com/docs/guides/database/postgres/row-level-security"
ADVISORS = "https://supabase.com/docs/guides/database/database-advisors?lint="

STATEMENTS = "repo_id string, path string, seq int, line int, text string, using_expr string, check_expr string"
# Up to the table of a policy; its clauses come after, whatever its name says.
POLICY_TABLE = re.compile(dict(STATEMENT_KINDS)["policy"])
# Pieces of SQL text that are read as one: comments, $tag$ bodies, quoted text, ends of statements.
PIECE = re.compile(
    r"(?P<line_comment>--[^\n]*)|(?P<block_comment>/\*.*?(?:\*/|\Z))|(?P<end>;)"
    r"|(?P<body>\$(?P<tag>[A-Za-z_]*)\$.*?(?:\$(?P=tag)\$|\Z))|(?P<quoted>'(?:[^']|'')*(?:'|\Z))|(?P<plain>[^-/;$']+|[-/$])",
    re.S,
)


def _statements(sql: str) -> Iterator[tuple[int, str]]:
    """(start line, blank-normalised text) of each statement."""
    line, start, parts = 1, None, []
    for piece in PIECE.finditer(sql):
        kind, text = piece.lastgroup, piece.group()
        kind = "body" if piece.group("body") is not None else kind
        if kind == "end":
            if "".join(parts).strip():
                yield start or line, " ".join("".join(parts).split())
            start, parts = None, []
            continue
        if kind == "block_comment":
            parts.append(" ")
        elif kind != "line_comment":
            if start is None and text.strip():
                start = line + text[: len(text) - len(text.lstrip())].count("\n")
            parts.append(text)
        line += text.count("\n")
    if "".join(parts).strip():
        yield start or line, " ".join("".join(parts).split())


def _clause(text: str, keyword: str) -> str | None:
    """The parenthesised expression after a keyword, to its balanced end."""
    opened = re.search(rf"\b{keyword}\s*\(", text, re.I)
    if not opened:
        return None
    depth, rest = 1, text[opened.end():]
    for mark in re.finditer(r"[()]", rest):
        depth += 1 if mark.group() == "(" else -1
        if depth == 0:
            return rest[: mark.start()].strip()
    return rest[:-1].strip()


def sql_statements(files: DataFrame) -> DataFrame:
    """(repo_id, path, seq, line, text, using_expr, check_expr) of every .sql file."""

    def split(batches):
        for batch in batches:
            rows = []
            for repo, path, content in zip(batch["repo_id"], batch["path"], batch["content"]):
                for seq, (line, text) in enumerate(_statements(content or "")):
                    policy = POLICY_TABLE.match(text)
                    after = text[policy.end():] if policy else ""
                    rows.append((repo, path, seq, line, text,
                                 _clause(after, "using") if policy else None,
                                 _clause(after, r"with\s+check") if policy else None))
            yield pd.DataFrame(rows, columns=["repo_id", "path", "seq", "line", "text", "using_expr", "check_expr"])

    sql_files = files.where(F.lower("path").endswith(".sql")).select("repo_id", "path", "content")
    return sql_files.mapInPandas(split, STATEMENTS)


def project_flags(files: DataFrame) -> DataFrame:
    """(repo_id, flagged): projects whose migrations are linted."""
    is_sql = F.lower("path").endswith(".sql")
    is_package = F.col("path").rlike(r"(^|/)package\.json$")
    named = is_sql & F.col("path").rlike(PROJECT_SQL_PATH)
    return files.groupBy("repo_id").agg(
        (F.bool_or(is_sql) & F.bool_or(named | (is_package & F.col("content").contains(PACKAGE_SCOPE)))).alias("flagged")
    )


def _name_parts(raw: Column) -> tuple[Column, Column]:
    parts = F.transform(F.split(raw, r"\.", -1), lambda p: F.lower(F.trim(F.replace(p, F.lit('"'), F.lit("")))))
    two = F.size(parts) > 1
    return F.when(two, parts[0]).otherwise("public"), F.when(two, parts[1]).otherwise(parts[0])


def normalise_name(df: DataFrame, raw: str) -> DataFrame:
    """Adds schema_name and object_name of an identifier; the default schema is public."""
    schema, name = _name_parts(F.col(raw))
    return df.withColumn("schema_name", schema).withColumn("object_name", name)


def classify_statement(statements: DataFrame) -> DataFrame:
    """Adds kind, schema_name and object_name; statements of no known kind are dropped."""
    text, kind, raw = F.col("text"), None, None
    for name, pattern in STATEMENT_KINDS:
        test, value = text.rlike(pattern), F.regexp_extract(text, pattern, 1)
        kind = F.when(test, name) if kind is None else kind.when(test, name)
        raw = F.when(test, value) if raw is None else raw.when(test, value)
    classified = statements.withColumn("kind", kind).withColumn("raw_name", raw).where(F.col("kind").isNotNull())
    return normalise_name(classified, "raw_name").drop("raw_name")


def parse_policy(policies: DataFrame) -> DataFrame:
    """Adds policy_name, command, roles, restrictive and what the expressions say."""
    rest = F.regexp_extract("text", POLICY_REST, 2)
    out = policies.withColumn("policy_name", F.replace(F.regexp_extract("text", POLICY_NAME, 1), F.lit('"'), F.lit("")))
    out = out.withColumn("rest", rest)
    command = F.nullif(F.lower(F.regexp_extract("rest", POLICY_COMMAND, 1)), F.lit(""))
    roles = F.nullif(F.regexp_extract("rest", POLICY_ROLES, 1), F.lit(""))
    expressions = F.array_compact(F.array("using_expr", "check_expr"))
    return out.select(
        *policies.columns, "policy_name",
        F.coalesce(command, F.lit("all")).alias("command"),
        F.coalesce(
            F.transform(F.split(roles, ",", -1), lambda r: F.lower(F.trim(F.replace(r, F.lit('"'), F.lit(""))))),
            F.array(F.lit("public")),
        ).alias("roles"),
        F.col("rest").rlike(r"(?i)(?<!\w)as\s+restrictive(?!\w)").alias("restrictive"),
        F.exists(expressions, lambda e: e.rlike(ALWAYS_TRUE)).alias("always_true"),
        F.exists(expressions, lambda e: e.rlike(USER_SCOPE)).alias("user_scoped"),
        (F.size(expressions) > 0).alias("has_expression"),
    )


def _hit(rule: str, severity, title: Column, detail: Column, fix: Column, reference: str,
         signal: int, ord_: int, rule_type: str = "ast_match") -> Column:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return F.struct(
        F.lit(rule).alias("rule"), severity.alias("severity"), title.alias("title"),
        F.lit("Database & Storage").alias("category"),
        F.concat(F.col("path"), F.lit(":"), F.col("line").cast("string"), F.lit(" "), detail).alias("evidence"),
        fix.alias("fix"), F.array(F.lit(reference)).alias("references"), F.lit(rule_type).alias("rule_type"),
        F.lit(signal).alias("signal"), F.lit(ord_).alias("ord"),
    )


def _expand(rows: DataFrame, hit: Column) -> DataFrame:
    found = rows.select("repo_id", F.col("path").alias("file"), "line", hit.alias("hit"))
    return found.where("hit is not null").select("repo_id", "file", "line", "hit.*")


def rls_not_enabled(statements: DataFrame) -> DataFrame:
    """Last definition of each public table that no migration of its project enables RLS on.

    One aggregate per (repository, table) replaces a self anti join: both facts
    about a table meet in the same group, pre-aggregated before the shuffle.
    """
    facts = statements.where((F.col("kind") == "enable") | ((F.col("kind") == "table") & (F.col("schema_name") == "public")))
    created = F.col("kind") == "table"
    last = F.max_by(F.struct("path", "line"), F.when(created, F.struct("path", "seq")))
    return facts.groupBy("repo_id", "object_name").agg(
        F.bool_or(F.col("kind") == "enable").alias("enabled"), last.alias("last"), F.bool_or(created).alias("created")
    ).where(F.col("created") & ~F.col("enabled")).select("repo_id", "object_name", "last.path", "last.line")


def lint_statements(statements: DataFrame) -> DataFrame:
    """Findings of classified statements of flagged projects, unmasked.

    A statement breaks at most one rule, so one pass with one case expression
    covers all rules but the one about tables without row level security.
    """
    cat, lit = F.concat, F.lit
    where = cat(F.col("schema_name"), lit("."), F.col("object_name"))
    parsed = parse_policy(statements)
    is_policy = (F.col("kind") == "policy") & ~F.col("restrictive")
    write = F.col("command") != "select"
    anon = F.arrays_overlap("roles", F.array(lit("anon"), lit("public")))
    name, command = F.col("policy_name"), F.col("command")
    made = cat(lit('create policy "'), name, lit('" on '), where, lit(" for "), command)
    write_true = _hit(
        "supabase.rls_policy_write_true", F.when(anon, "critical").otherwise("high"),
        cat(lit('RLS policy "'), name, lit('" lets '), F.when(anon, "anyone").otherwise("any signed-in user"), lit(" "),
            command, lit(" any row of "), where),
        cat(made, lit(" … (true)")),
        cat(lit("Scope the policy to the row owner, e.g. using (auth.uid() = user_id) with check (auth.uid() = user_id). "
                "A (true) "), command, lit(" policy means the anon key in your frontend can modify every row.")),
        DOCS, 6, 2000)
    unscoped = _hit(
        "supabase.rls_policy_not_user_scoped", "high",
        cat(lit("RLS "), command, lit(' policy "'), name, lit('" on '), where, lit(" never checks auth.uid()")),
        cat(made, lit(" — no auth.uid() / auth.jwt() in USING or WITH CHECK")),
        lit("Write policies should compare the row's owner column to auth.uid() (or a claim from auth.jwt()). Otherwise "
            "any user can modify rows that aren't theirs."), DOCS, 1, 2001, "semantic_match")
    public_read = _hit(
        "supabase.rls_policy_public_read", "medium",
        cat(lit('RLS policy "'), name, lit('" makes every row of '), where, lit(" readable with the anon key")),
        cat(lit('create policy "'), name, lit('" on '), where, lit(" for select using (true)")),
        lit("Fine for genuinely public content (blog posts, product catalogue). If the table holds anything per-user — "
            "emails, billing, private notes — restrict it with using (auth.uid() = user_id)."), DOCS, 0, 2002)
    public = cat(lit("public."), F.col("object_name"))
    bypass = _hit(
        "supabase.view_bypasses_rls", "high",
        cat(lit("View "), public, lit(" runs with its owner's rights and bypasses RLS")),
        cat(lit("create view "), public, lit(" without security_invoker")),
        cat(lit("Create it as create view "), public, lit(" with (security_invoker = true) as … (Postgres 15+), or move it "
                                                          "out of the exposed public schema.")),
        ADVISORS + "0010_security_definer_view", 2, 2003)
    definer = _hit(
        "supabase.security_definer_search_path", "medium",
        cat(lit("SECURITY DEFINER function "), where, lit(" has no fixed search_path")),
        cat(lit("create function "), where, lit(" … security definer (no set search_path)")),
        lit("Add set search_path = '' (and schema-qualify every table inside), so a caller can't shadow tables and run "
            "code with the function owner's privileges."), ADVISORS + "0011_function_search_path_mutable", 2, 2004)
    open_table = _hit(
        "supabase.rls_not_enabled", "critical",
        cat(lit("Table "), public, lit(" is created without row level security")),
        cat(lit("create table "), public, lit(' — no "alter table … enable row level security" in any migration')),
        cat(lit("Add alter table "), public, lit(" enable row level security; and policies scoped with auth.uid(). "
            "Without RLS, anyone with your anon key (it ships in your frontend) can read and write every row.")),
        DOCS, 6, 2005)
    text, flag = F.col("text"), F.col
    per_statement = (
        F.when(is_policy & write & flag("always_true"), write_true)
        .when(is_policy & write & ~flag("user_scoped") & flag("has_expression"), unscoped)
        .when(is_policy & ~write & flag("always_true") & anon, public_read)
        .when((F.col("kind") == "view") & (F.col("schema_name") == "public")
              & ~text.rlike(r"(?i)security_invoker\s*=\s*(true|on)")
              & ~F.left(text, lit(40)).rlike("(?i)materialized"), bypass)
        .when((F.col("kind") == "function") & text.rlike(r"(?i)(?<!\w)security\s+definer(?!\w)")
              & ~text.rlike(r"(?i)(?<!\w)set\s+search_path(?!\w)"), definer)
    )
    return _expand(parsed, per_statement).unionByName(_expand(rls_not_enabled(statements), open_table))


def lint_migrations(files: DataFrame) -> DataFrame:
    """All migration findings of flagged projects.

    The classified statements feed two branches, so they are checkpointed: the
    files are split once, and the result survives a lost executor.
    """
    flagged = project_flags(files).where("flagged").select("repo_id")
    classified = join_lookup(classify_statement(sql_statements(files)), flagged, ["repo_id"], ["path"], "inner")
    return assemble_findings(lint_statements(settle(classified)))
