"""The built-in rules.

Patterns are Java regular expressions. ``(?<!\\w)`` and ``(?!\\w)`` stand for an
ASCII word boundary, which Java's ``\\b`` is not on every release.
"""

from __future__ import annotations

from lintlake.functions.sqltext import all_of, any_of, contains_any, matches
from lintlake.operators.rules.rule import CallTest, Rule

INJECTION = "Injection Vulnerabilities"
AUTH = "Authentication & Authorization"
EXPOSURE = "Data Exposure"
INFRA = "Infrastructure & Deployment"
DATABASE = "Database & Storage"
XSS = "Cross-Site Scripting"
LOGIC = "Business Logic"
API_KEYS = "API & Third-party Keys"

# ---------------------------------------------------------------------------
# Credential patterns, shared by file and bundle scans, as
# (rule suffix, pattern, label, literals every match contains one of).
SECRET_PATTERNS = [
    ("stripe_live", r"(?<!\w)[sr]k_live_[A-Za-z0-9]{16,}", "Stripe live secret key", ("k_live_",)),
    ("stripe_test", r"(?<!\w)[sr]k_test_[A-Za-z0-9]{16,}", "Stripe test secret key", ("k_test_",)),
    ("github_pat", r"ghp_[A-Za-z0-9_]{20,}", "GitHub PAT", ("ghp_",)),
    ("github_fine_pat", r"github_pat_[A-Za-z0-9_]{20,}", "GitHub fine-grained PAT", ("github_pat_",)),
    ("aws_key", r"AKIA[A-Z0-9]{12,}", "AWS access key id", ("AKIA",)),
    ("slack_token", r"xox[abprs]-[A-Za-z0-9-]{12,}", "Slack token", ("xox",)),
    ("openai_key", r"sk-proj-[A-Za-z0-9_-]{12,}", "OpenAI project key", ("sk-proj-",)),
    ("sendgrid_key", r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}", "SendGrid API key", ("SG.",)),
    ("twilio_account", r"AC[a-f0-9]{32}", "Twilio account SID", ("AC",)),
    ("resend_key", r"re_[A-Za-z0-9_]{16,}", "Resend API key", ("re_",)),
    ("supabase_service_role", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
     "JWT (possibly Supabase service role)", ("eyJ",)),
]
# The credential kinds looked for inside quoted strings.
LITERAL_CREDENTIALS = [
    (r"(?<!\w)[sr]k_(?:live|test)_[A-Za-z0-9]{16,}", "Stripe secret key", ("k_live_", "k_test_")),
    (r"sk-proj-[A-Za-z0-9_-]{12,}", "OpenAI project key", ("sk-proj-",)),
    (r"ghp_[A-Za-z0-9_]{20,}", "GitHub PAT", ("ghp_",)),
    (r"github_pat_[A-Za-z0-9_]{20,}", "GitHub fine-grained PAT", ("github_pat_",)),
    (r"AKIA[A-Z0-9]{12,}", "AWS access key id", ("AKIA",)),
    (r"xox[abprs]-[A-Za-z0-9-]{12,}", "Slack token", ("xox",)),
]
ENV_FILE_PATH = r"(?i)(^|/)\.env(\.|$)|\.env\.local$|\.env\.example$|\.env\.production$"
ENV_ASSIGNMENT = r"^\s*([A-Z0-9_]+)\s*=\s*(.+)$"
ENV_PUBLIC_NAME = (
    r"(?i)^(NEXT_PUBLIC|VITE|PUBLIC|REACT_APP)_[A-Z0-9_]*"
    r"(SECRET|PRIVATE|API_?KEY|TOKEN|PASSWORD|SERVICE_ROLE)"
)
ENV_PUBLIC_LINE = (
    r"^\s*(?i:(?:NEXT_PUBLIC|VITE|PUBLIC|REACT_APP)_[A-Z0-9_]*"
    r"(?:SECRET|PRIVATE|API_?KEY|TOKEN|PASSWORD|SERVICE_ROLE))"
)
ROTATE = "Revoke and rotate the credential, remove it from git history, and load it from a secret manager."

# Path and guard patterns of the file rules.
NEXT_ROUTE_PATH = r"(?i)(^|/)app/.+/route\.(ts|tsx|js|jsx|mjs|cjs)$"
API_DIR_PATH = r"(?i)(^|/)(api|routes|server|controllers)/"
HANDLER_NAME_PATH = r"\.(controller|route|handler)\.(js|ts|tsx|jsx|mjs|cjs)$"
PRIVATE_SEGMENT_PATH = r"(^|/)_[^/]+/"
WEBHOOK_PATH = r"(?i)webhook"
HANDLER_CODE = (
    r"((module\.exports|exports\.\w+)\s*=|export\s+default)\s*(async\s+)?(function\s*\w*\s*)?\(\s*\{?\s*req(?!\w)"
    r"|(?<!\w)export\s+(async\s+)?function\s+(GET|POST|PUT|PATCH|DELETE|handler)(?!\w)"
    r"|(?<!\w)(router|app|server|fastify)\.(get|post|put|patch|delete|all|route)\s*\("
)
GUARD_WORDS = (
    r"(?i)(requireUser|requireAuth|getServerSession|authMiddleware|verifyToken|withAuth|"
    r"isAuthenticated|currentUser|protect\()"
)
GUARD_CALLS = r"(?<!\w)(require|ensure|get|verify)(User|Auth|Session|Principal|Admin|Login)\s*\("
AUTH_NEARBY = (
    r"(?i)(auth\s*\(|getServerSession|currentUser\s*\(|requireUser|requireAuth|withAuth|protectRoute|"
    r"isAuthenticated|session\.user|user\?\.id|user\.id)"
)
WEBHOOK_PARSES = r"(?i)(req\.body|JSON\.parse|request\.json|request\.text|await\s+request\.formData)"
WEBHOOK_VERIFIES = (
    r"(webhooks\.constructEvent|new\s+Webhook\s*\(|(?<!\w)wh\.verify\s*\(|timingSafeEqual|createHmac\s*\(|"
    r"crypto\.subtle\.verify|verify(Webhook)?Signature\s*\(|verifyWebhook\s*\(|validateRequest\s*\(|verifyKey\s*\()"
)
CLERK_VERIFIES = r"Webhook\s*\(\s*[^)]+\)|wh\.verify\s*\("
PUBLIC_SECRET_NAME = r"(?i)(NEXT_PUBLIC|VITE|PUBLIC)_[A-Z_]*(SECRET|PRIVATE|API_KEY|TOKEN)"
USE_CLIENT = r"(?m)^\s*[\"']use client[\"']"
PY_ROUTE = r"@\w+\.route\s*\(|@app\.(get|post|put|delete|patch)\s*\("
PY_VIEW = r"class\s+\w+View(?!\w)|def\s+\w+_view(?!\w)"
PY_VIEW_PATH = r"(?<!\w)views\.py$"
PY_GUARD = r"(?i)(login_required|permission_classes|@authentication_classes|request\.user\.is_authenticated|require_auth)"
RB_CONTROLLER = r"class\s+\w+Controller"
RB_GUARD = r"before_action\s*:[a-z_]+"
RB_WRITE = r"\.(create|update|destroy)(?!\w)"
GO_GUARD = r"(?i)auth|middleware|protect|verify"
REQUEST_INPUT = r"(?:req\.(?:body|query|params|headers)|ctx\.(?:request|params)|(?<!\w)userInput(?!\w)|(?<!\w)input(?!\w))"


def _line(rule, severity, title, category, fix, languages, pattern, needles, **extra) -> Rule:
    return Rule(rule, severity, title, category, fix, "line", languages, pattern, needles=needles, **extra)


def _span(rule, severity, title, category, fix, pattern, shown, needles, **extra) -> Rule:
    return Rule(rule, severity, title, category, fix, "span", ("javascript",), pattern,
                shown=shown, needles=needles, **extra)


def _call(rule, severity, title, category, fix, callee, test, shown, needles, **extra) -> Rule:
    return Rule(rule, severity, title, category, fix, "call", ("javascript",), callee,
                shown=shown, needles=needles, call=test, **extra)


def _file(rule, severity, title, category, fix, languages, file_when, shown, **extra) -> Rule:
    return Rule(rule, severity, title, category, fix, "file", languages,
                file_when=file_when, shown=shown, **extra)


def _in(column: str, pattern: str) -> str:
    return matches(column, pattern)


# Conditions of the file rules, over content and path.
PYTHON_UNGUARDED = all_of([any_of([_in("content", PY_ROUTE), _in("content", PY_VIEW), _in("path", PY_VIEW_PATH)]),
                           "NOT " + _in("content", PY_GUARD)])
RAILS_UNGUARDED = all_of([_in("content", RB_CONTROLLER), "NOT " + _in("content", RB_GUARD), _in("content", RB_WRITE)])
API_ROUTE_UNGUARDED = all_of([
    any_of([_in("path", API_DIR_PATH), _in("path", HANDLER_NAME_PATH)]), "NOT " + _in("path", PRIVATE_SEGMENT_PATH),
    "NOT " + _in("path", WEBHOOK_PATH), "NOT " + _in("path", NEXT_ROUTE_PATH), _in("content", HANDLER_CODE),
    "NOT " + _in("content", GUARD_WORDS), "NOT " + _in("content", GUARD_CALLS)])
WEBHOOK_UNVERIFIED = all_of([_in("path", WEBHOOK_PATH), "NOT " + _in("content", "(?i)clerk"),
                             _in("content", WEBHOOK_PARSES), "NOT " + _in("content", WEBHOOK_VERIFIES)])
CLERK_UNVERIFIED = all_of([_in("path", WEBHOOK_PATH), _in("content", "(?i)clerk"), "NOT " + _in("content", CLERK_VERIFIES)])
PUBLIC_SECRET = all_of([contains_any("lower(content)", ["public_", "vite_"]), _in("content", PUBLIC_SECRET_NAME)])
CLIENT_FILE = all_of(["contains(content, 'use client')", _in("content", USE_CLIENT)])
SERVICE_ROLE_IN_CLIENT = all_of(["contains(content, 'SUPABASE_SERVICE_ROLE_KEY')", CLIENT_FILE])
OPEN_NEXT_ROUTE = all_of([_in("path", NEXT_ROUTE_PATH), "NOT " + _in("path", WEBHOOK_PATH), "NOT " + _in("content", AUTH_NEARBY)])
GO_UNGUARDED = "NOT " + _in("content", GO_GUARD)

PY, RB, GO, PHP, SQL, JS = ("python",), ("ruby",), ("go",), ("php",), ("sql",), ("javascript",)

# ---------------------------------------------------------------------------
# Rule ids, severities, titles, categories, fixes, references,
# rule types and signals of the findings, with their patterns.
JAVASCRIPT_RULES = [
    *[_line("secrets.literal_credential", "critical", f"Committed {label}", EXPOSURE, ROTATE, JS,
            r"[\"']([^\"'\n]*" + pattern + r"[^\"'\n]*)[\"']", needles, raw=True, shown="$1",
            references=("https://docs.github.com/code-security/secret-scanning",),
            rule_type="literal_credential")
      for pattern, label, needles in LITERAL_CREDENTIALS],
    _span("auth.token_in_browser_storage", "high", "Authentication token stored in browser storage", AUTH,
          "Store session tokens in httpOnly Secure SameSite cookies or short-lived in-memory values with refresh rotation.",
          r"(?<![\w.])((?:localStorage|sessionStorage)\.setItem)\s*\(\s*[\"'`]"
          r"((?i:token|jwt|accessToken|access_token|auth|session|authToken|refreshToken|refresh_token))[\"'`]",
          "$1('$2', ...)", ("Storage.setItem",),
          references=("https://owasp.org/www-community/HttpOnly",), signal=4),
    _call("auth.weak_jwt_secret", "critical", "Hardcoded or weak JWT signing secret", AUTH,
          "Read the signing secret from environment configuration with at least 32 bytes of entropy, and rotate it on compromise.",
          r"jwt\.sign", CallTest(1, mode="literal", pattern=r"[^\n]{0,23}"),
          "jwt.sign(..., '$2', ...)", ("jwt.sign",),
          references=("https://datatracker.ietf.org/doc/html/rfc8725",), signal=6),
    _call("injection.shell_command", "critical", "User input flows into shell execution", INJECTION,
          "Avoid the shell. Use an argument array form, an allowlist, and never interpolate raw request data.",
          r"(?:child_process\.)?exec(?:Sync)?", CallTest(mode="code", pattern=REQUEST_INPUT),
          "$1(<user-input>)", ("exec",),
          references=("https://owasp.org/www-community/attacks/Command_Injection",), signal=6),
    _span("injection.dynamic_code", "high", "Dynamic code execution via %s()", INJECTION,
          "Replace eval/Function with explicit parsers, schema validation, or safe templating.",
          r"(?<![\w.])(eval|Function)\s*\(", "$1(...)", ("eval", "Function"), subject="$1", signal=2),
    _span("injection.sql_template", "critical", "Possible SQL injection via template literal", INJECTION,
          "Use parameterized queries or ORM bindings. Never interpolate request data into SQL.",
          r"(?<![\w.])((?:db|client|pool|sequelize)\.query|knex\.raw)\s*\(\s*`[^`]*\$\{\s*(?:req\.|params|query|body|ctx\.request)",
          "$1(`SELECT ... ${user}`)", (".query", ".raw"),
          references=("https://owasp.org/www-community/attacks/SQL_Injection",), signal=6),
    _span("injection.sql_concat", "critical", "Possible SQL injection via string concatenation", INJECTION,
          "Use parameterized queries and bind variables.",
          r"(?<![\w.])((?:db|client|pool|sequelize)\.query|knex\.raw)\s*\(\s*(?:\"[^\"\n]*\"|'[^'\n]*'|[\w$.]+)\s*\+",
          "$1('...' + req.*)", (".query", ".raw"),
          references=("https://owasp.org/www-community/attacks/SQL_Injection",), signal=4),
    _call("logic.mass_assignment", "high", "Mass assignment into ORM update", LOGIC,
          "Explicitly pick allowed fields before passing them to the ORM. Reject unexpected properties.",
          r"prisma\.[A-Za-z0-9_]+\.(?:update|upsert|create)",
          CallTest(0, ("data",), "name", r"req\.(?:body|query|params)[\w.]*|[A-Za-z_$][\w$]*"),
          "$1({ data: $2 })", ("prisma.",), signal=4),
    _span("logic.predictable_random", "high", "Predictable random used for security-sensitive value", LOGIC,
          "Use crypto.randomBytes / Web Crypto getRandomValues for tokens, resets, OTPs, and invites.",
          r"(?<![\w.])(\w*(?i:token|reset|invite|otp|code|nonce)\w*)\s*=\s*[^;\n]*?Math\.random\s*\(",
          "$1 = Math.random()", ("Math.random",), signal=4),
    _call("infra.open_cors", "high", "Open CORS policy permits any origin", INFRA,
          "List specific origins per environment. Never combine wildcard origins with credentialed APIs.",
          r"cors", CallTest(0, ("origin",), "literal", r"\*"),
          "cors({ origin: '*' })", ("cors",), signal=3),
    _span("xss.inner_html", "medium", "Raw HTML rendering path", XSS,
          "Render text by default. If HTML is required, sanitize with a strict allowlist (DOMPurify) before display.",
          r"(?<![\w.])([\w.]*\.(?:innerHTML|outerHTML))\s*\+?=[^=]",
          "$1 = ...", ("innerHTML", "outerHTML"),
          references=("https://owasp.org/www-community/attacks/xss/",), signal=2),
    _span("xss.dangerously_set_inner_html", "medium", "dangerouslySetInnerHTML used in JSX", XSS,
          "Render text by default or sanitize the HTML with a strict allowlist before assignment.",
          r"(?<![\w.])dangerouslySetInnerHTML\s*=\s*\{",
          "dangerouslySetInnerHTML={...}", ("dangerouslySetInnerHTML",), signal=1),
    _file("auth.unprotected_route", "medium", "API route has no obvious authentication guard", AUTH,
          "Require authentication middleware or server-side session checks on every non-public API route.",
          JS, API_ROUTE_UNGUARDED, "contains route code without recognizable auth/session guard",
          rule_type="semantic_match", signal=-2),
    _file("webhooks.unverified_signature", "critical", "Webhook handler lacks signature verification", API_KEYS,
          "Verify the provider signature against the raw request body before trusting any webhook payload.",
          JS, WEBHOOK_UNVERIFIED, "parses webhook payload without constructEvent / signature verification",
          references=("https://stripe.com/docs/webhooks/signatures",), rule_type="semantic_match", signal=4),
    _file("secrets.client_bundle_exposure", "high", "Server-only secret exposed via public env prefix", API_KEYS,
          "Drop the public prefix for any value that must stay on the server, and rotate the exposed credential.",
          JS, PUBLIC_SECRET, "references a public-prefixed secret name",
          rule_type="semantic_match", signal=3),
    _line("auth.weak_jwt_secret", "critical", "Hardcoded JWT signing secret (heuristic)", AUTH,
          "Load JWT secrets from environment with strong entropy and rotate them.", JS,
          r"(?i)jwt\.sign\s*\([^)]*['\"`](secret|changeme|jwt_secret)['\"`]", ("jwt.sign",), fold_case=True, raw=True,
          unless_pattern=r"(?i),\s*['\"`](?:secret|changeme|jwt_secret)['\"`]"),
    _span("nextjs.route_handler_no_auth", "high", "Next.js %s route handler has no visible auth check", AUTH,
          "Call await auth() / await currentUser() / await getServerSession() at the top of the handler and 401 if the "
          "principal is missing. Or wrap the file in a middleware-protected segment.",
          r"(?<![\w.])export\s+(?:async\s+)?(?:function|const)\s+(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)(?!\w)",
          "export async function $1() — no recognizable auth() / getServerSession() / currentUser() call",
          ("export",), subject="$1", file_when=OPEN_NEXT_ROUTE, rule_type="semantic_match",
          references=("https://nextjs.org/docs/app/building-your-application/authentication",), signal=2),
    _call("nextjs.cookies_missing_options", "medium", "cookies().set without httpOnly / secure / sameSite", AUTH,
          "Always pass { httpOnly: true, secure: true, sameSite: 'lax', path: '/' } to cookies().set. Otherwise the "
          "cookie is readable by document.cookie and replayable across sites.",
          r"cookies(?:\(\))?\.set", CallTest(keys=("httpOnly",), missing=True),
          "cookies.set(...) missing { httpOnly, secure, sameSite }", ("cookies",), signal=2),
    _call("nextjs.cookies_missing_options", "medium", "cookies().set without httpOnly / secure / sameSite", AUTH,
          "Always pass { httpOnly: true, secure: true, sameSite: 'lax', path: '/' } to cookies().set. Otherwise the "
          "cookie is readable by document.cookie and replayable across sites.",
          r"cookieStore\.set|.*\.cookies\.set", CallTest(keys=("httpOnly",), missing=True),
          "$1(...) missing { httpOnly, secure, sameSite }", ("cookieStore", ".cookies"), signal=2),
    _file("supabase.service_role_client_side", "critical", "Supabase service-role key referenced in a client component",
          EXPOSURE,
          "The service-role key bypasses RLS and must never reach the browser. Use NEXT_PUBLIC_SUPABASE_ANON_KEY in "
          "client code and put service-role logic in a server action or route handler.",
          JS, SERVICE_ROLE_IN_CLIENT, "is a 'use client' component but references SUPABASE_SERVICE_ROLE_KEY",
          rule_type="semantic_match", signal=6),
    _call("supabase.service_role_in_client_bundle", "critical",
          "createClient called with service-role key in a client component", EXPOSURE,
          "Move this call to a server-only file (route handler or server action). Use the anon key for browser code.",
          r"createClient|createServerClient", CallTest(1, mode="name", pattern=r"[\w.]*SERVICE_ROLE\w*"),
          "createClient(url, $2)", ("SERVICE_ROLE",), file_when=CLIENT_FILE, signal=6),
    _span("supabase.auth_admin_call", "high", "supabase.auth.admin call — verify caller is privileged", AUTH,
          "Restrict admin-API calls to authenticated administrators. Check the session user's role before invoking auth.admin.*.",
          r"(?<![\w.])(supabase\.auth\.admin\.[\w.]+)\s*\(", "$1(...)", ("supabase.auth.admin",), signal=2),
    _call("stripe.idempotency_missing", "medium", "Stripe %s called without an idempotencyKey", LOGIC,
          "Pass an idempotencyKey as the second arg (e.g. await stripe.X.create({...}, { idempotencyKey })). Otherwise a "
          "retry can double-charge or duplicate-create.",
          r"stripe\.(?:charges|paymentIntents|subscriptions|invoices|customers|refunds|setupIntents|checkout\.sessions)\.(?:create|update)",
          CallTest(1, ("idempotencyKey", "idempotency_key"), missing=True),
          "$1(...) without { idempotencyKey: ... }", ("stripe.",), subject="$1",
          references=("https://stripe.com/docs/api/idempotent_requests",), signal=2),
    _file("clerk.webhook_unverified", "critical", "Clerk webhook handler does not verify the svix signature", API_KEYS,
          "Read the raw request body, pull svix-id / svix-timestamp / svix-signature headers, and call new "
          "Webhook(secret).verify(rawBody, headers) before trusting any payload field.",
          JS, CLERK_UNVERIFIED,
          "appears to handle Clerk webhooks but does not import svix or call Webhook(secret).verify(payload, headers)",
          references=("https://clerk.com/docs/integrations/webhooks/sync-data#verifying-the-webhook",),
          rule_type="semantic_match", signal=5),
]

PYTHON_RULES = [
    _line("py.shell_injection", "critical", "User input flows into subprocess with shell=True", INJECTION,
          "Pass an argument list, drop shell=True, and validate input against a strict allowlist.", PY,
          r"(?<!\w)subprocess\.(call|run|Popen|check_output)\s*\(.*shell\s*=\s*True", ("subprocess.",),
          also=(r"(request\.|input\(|sys\.argv)",), signal=4),
    _line("py.os_system_user_input", "critical", "User input reaches os.system", INJECTION,
          "Replace os.system with subprocess.run([...]) using an argument list, no shell.", PY,
          r"(?<!\w)os\.system\s*\(.*(request\.|input\()", ("os.system",), signal=4),
    _line("py.sql_injection", "critical", "Possible SQL injection via string formatting", INJECTION,
          "Pass parameters as the second argument to cursor.execute. Never format SQL with f-strings or %.", PY,
          r"(?<!\w)cursor\.execute\s*\(\s*(['\"`].*%s.*['\"`]\s*%\s*|f['\"])", ("cursor.execute",), signal=4),
    _line("py.django_debug_true", "high", "Django DEBUG=True committed to settings", INFRA,
          "Set DEBUG via environment with a safe default of False; never ship DEBUG=True.", PY,
          r"(?<!\w)DEBUG\s*=\s*True(?!\w)", ("DEBUG",), path_pattern=r"settings\.py$"),
    _line("py.weak_secret_key", "critical", "Weak or short application SECRET_KEY", AUTH,
          "Read SECRET_KEY from environment with at least 32 bytes of entropy.", PY,
          r"(secret_key|SECRET_KEY)\s*=\s*['\"][^'\"]{0,24}['\"]", ("secret_key", "SECRET_KEY")),
    _line("py.yaml_unsafe_load", "high", "yaml.load without SafeLoader", INJECTION,
          "Use yaml.safe_load or pass Loader=yaml.SafeLoader to avoid arbitrary object instantiation.", PY,
          r"yaml\.load\s*\(", ("yaml.load",), unless="SafeLoader"),
    _line("py.pickle_loads_untrusted", "critical", "pickle.loads on user-supplied data", INJECTION,
          "Never pickle.loads untrusted input. Use JSON or a typed schema.", PY,
          r"(?<!\w)pickle\.loads\s*\(.*(request\.|body|payload|user)", ("pickle.loads",), signal=4),
    _line("py.dynamic_eval", "critical", "Dynamic eval/exec on user input", INJECTION,
          "Avoid eval/exec on untrusted data. Parse with json, ast.literal_eval, or a typed validator.", PY,
          r"(?<!\w)(eval|exec)\s*\(.*(request\.|input\()", ("eval", "exec"), signal=4),
    _line("py.tls_verify_disabled", "high", "TLS verification disabled on outbound request", INFRA,
          "Always verify TLS certificates. Use a custom CA bundle if needed instead of verify=False.", PY,
          r"requests\.(get|post|put|delete|patch)\s*\([^)]*verify\s*=\s*False", ("requests.",)),
    _file("py.unprotected_route", "medium", "Python route has no obvious authentication guard", AUTH,
          "Wrap views with login_required, IsAuthenticated permissions, or your auth middleware.", PY,
          PYTHON_UNGUARDED, "declares an HTTP handler without login_required / permission checks",
          rule_type="semantic_match", signal=-2),
]

RUBY_RULES = [
    _line("rb.shell_injection", "critical", "User input flows into shell command", INJECTION,
          "Use system with an argv array form and a strict allowlist for any input that influences arguments.", RB,
          r"(?i)`[^`]*#\{[^}]*params|system\s*\(\s*[\"'].*#\{[^}]*params", ("params",), fold_case=True, signal=4),
    _line("rb.sql_interpolation", "critical", "SQL string interpolation in ActiveRecord query", INJECTION,
          "Use parameter placeholders (e.g. where('email = ?', email)) or hash conditions.", RB,
          r"(?i)\.(where|find_by_sql)\s*\(\s*[\"'].*#\{[^}]+\}", (".where", ".find_by_sql"), fold_case=True, signal=4),
    _line("rb.csrf_disabled", "high", "CSRF protection disabled in Rails controller", "Cross-Site Request Forgery",
          "Leave protect_from_forgery enabled. Scope skip_before_action to APIs that use signed tokens.", RB,
          r"skip_before_action\s+:verify_authenticity_token", ("skip_before_action",)),
    _line("rb.marshal_untrusted", "critical", "Marshal.load on untrusted data", INJECTION,
          "Marshal.load executes arbitrary code. Replace with JSON.parse or a typed parser.", RB,
          r"Marshal\.load\s*\(\s*(params|request|body)", ("Marshal.load",), signal=4),
    _file("rb.unprotected_controller", "medium", "Rails controller performs writes without a before_action guard", AUTH,
          "Add a before_action :authenticate_user! (Devise) or equivalent guard.", RB,
          RAILS_UNGUARDED, "controller mutates records without a recognizable auth before_action",
          rule_type="semantic_match", signal=-2),
]

GO_RULES = [
    _line("go.shell_injection", "critical", "User input passed to exec.Command", INJECTION,
          "Validate against an allowlist and use a fixed argv. Never let request data control the binary path.", GO,
          r"exec\.Command\([^,]+,\s*[^)]+r\.(URL\.Query|FormValue)", ("exec.Command",), signal=4),
    _line("go.sql_sprintf", "critical", "SQL built with fmt.Sprintf", INJECTION,
          "Use parameterized queries (e.g. db.Query(\"SELECT ... WHERE id = $1\", id)).", GO,
          r"db\.(Exec|Query|QueryRow)\s*\(\s*fmt\.Sprintf", ("fmt.Sprintf",), signal=4),
    _line("go.tls_insecure", "high", "TLS verification disabled (InsecureSkipVerify: true)", INFRA,
          "Trust the system CA store. Use a custom RootCAs pool if you need to pin certificates.", GO,
          r"tls\.Config\s*\{[^}]*InsecureSkipVerify\s*:\s*true", ("InsecureSkipVerify",)),
    _line("go.unprotected_route", "medium", "Go HTTP handler exposes /api without visible auth wrapper", AUTH,
          "Wrap handlers in an auth middleware or check r.Context for the authenticated principal.", GO,
          r"http\.HandleFunc\s*\(\s*\"/api", ("http.HandleFunc",), file_when=GO_UNGUARDED,
          rule_type="semantic_match", signal=-2),
]

PHP_RULES = [
    _line("php.sql_injection", "critical", "Raw SQL with $_GET/$_POST interpolation", INJECTION,
          "Use PDO prepared statements with bound parameters. Never interpolate $_GET/$_POST into SQL.", PHP,
          r"(mysql_query|mysqli_query|->query)\s*\(\s*[\"'][^\"']*\$_(GET|POST|REQUEST)", ("query",), signal=4),
    _line("php.command_injection", "critical", "User input in shell command", INJECTION,
          "Avoid shell execution. If unavoidable, use escapeshellarg / argv-style execution with a strict allowlist.", PHP,
          r"(?<!\w)(shell_exec|exec|passthru|system)\s*\(\s*\$_(GET|POST|REQUEST)", ("$_",), signal=4),
    _line("php.unserialize_user_input", "critical", "unserialize() on user-controlled data", INJECTION,
          "Never unserialize untrusted input. Use json_decode with strict typing instead.", PHP,
          r"unserialize\s*\(\s*\$_(GET|POST|REQUEST|COOKIE)", ("unserialize",), signal=4),
    _line("php.eval_user_input", "critical", "eval() on user-controlled data", INJECTION,
          "Remove eval entirely. Parse data with json_decode or run user logic in a sandbox.", PHP,
          r"(?<!\w)eval\s*\(\s*\$_(GET|POST|REQUEST)", ("eval",), signal=4),
    _line("php.local_file_inclusion", "critical", "Local file inclusion via user input", INJECTION,
          "Resolve include paths from a whitelist or static map. Never pass request data straight into include/require.", PHP,
          r"(include|require)(_once)?\s*\(\s*\$_(GET|POST|REQUEST)", ("include", "require"), signal=4),
]

SQL_RULES = [
    _line("db.rls_disabled", "critical", "Row Level Security disabled", DATABASE,
          "Enable RLS on exposed tables and add role-specific policies for SELECT, INSERT, UPDATE, DELETE.", SQL,
          r"(?i)alter\s+table[^;]+disable\s+row\s+level\s+security|(?<!\w)rls\s*=\s*false(?!\w)",
          ("disable", "rls"), fold_case=True, signal=4),
    _line("db.public_grant", "high", "Permissive GRANT to anonymous role", DATABASE,
          "Restrict grants by role. Avoid granting write privileges to anon/public.", SQL,
          r"(?i)grant\s+(all|select|insert|update|delete)(?!\w)[^;]*(?<!\w)to\s+(anon|public)(?!\w)",
          ("grant",), fold_case=True),
]

SECRET_RULES = [
    _line(f"secrets.{name}", "critical", f"Committed {label}", EXPOSURE, ROTATE, (), pattern, needles,
          raw=True, rule_type="literal_credential")
    for name, pattern, label, needles in SECRET_PATTERNS
] + [
    _line("secrets.env_public_secret", "high", "Public-prefixed env var holds a secret: %s", EXPOSURE,
          "Public-prefixed env vars (NEXT_PUBLIC_, VITE_, PUBLIC_, REACT_APP_) end up in the client bundle. Drop the "
          "prefix for any value that should stay server-side, and rotate the credential.", (),
          ENV_ASSIGNMENT, ("next_public", "vite", "public", "react_app"), fold_case=True, raw=True,
          also=(ENV_PUBLIC_LINE,), path_pattern=ENV_FILE_PATH, shown="$1=<value>", subject="$1", signal=3),
]

# Language rules come before the credential rules, as they are reported.
RULEBOOK: list[Rule] = (
    JAVASCRIPT_RULES + PYTHON_RULES + RUBY_RULES + GO_RULES + PHP_RULES + SQL_RULES + SECRET_RULES
)


def rules_for(*prefixes: str) -> list[Rule]:
    """Built-in rules whose id starts with one of the prefixes, in order."""
    return [rule for rule in RULEBOOK if rule.rule.startswith(prefixes)]
