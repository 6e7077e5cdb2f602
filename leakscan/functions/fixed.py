"""Fixed values of the scan: names, patterns, weights and thresholds that define its results."""

# --- files --------------------------------------------------------------------------------------
BINARY_EXTENSIONS = """
.png .jpg .jpeg .gif .bmp .ico .webp .tiff .avif .mp4 .mp3 .wav .avi .mov .mkv .flv .ogg .webm .pdf .doc .docx .xls .xlsx .ppt .pptx .odt
.zip .tar .gz .rar .7z .bz2 .xz .lz4 .zst .exe .dll .so .dylib .lib .a .o .obj .woff .woff2 .ttf .eot .otf .class .jar .war .ear .pyc .pyo .pyd
.db .sqlite .sqlite3 .bin .dat .pak .map
""".split()
EXCLUDED_GLOBS = """
**/node_modules/** **/dist/** **/build/** **/.next/** **/out/** **/__pycache__/** **/*.min.js **/*.min.css **/*.bundle.js **/*.chunk.js
**/coverage/** **/.nuxt/** **/.output/** **/vendor/** **/.venv/** **/venv/** **/Pods/** **/.gradle/** **/.m2/** **/package-lock.json
**/yarn.lock **/pnpm-lock.yaml **/Gemfile.lock **/poetry.lock **/Cargo.lock **/composer.lock **/go.sum **/Pipfile.lock **/.git/** **/.svn/**
""".split()
HIGH_NAMES = """
.env secrets.json credentials.json credentials.yaml credentials.yml service-account.json serviceaccount.json keyfile.json key.json secret.json
private.json .netrc .pgpass .my.cnf .boto .s3cfg kubeconfig
""".split()
HIGH_PREFIX = ".env."
ELEVATED_NAMES = """
application.yml application.yaml application.properties config.json config.yaml config.yml config.toml settings.json settings.py settings.yaml
settings.yml docker-compose.yml docker-compose.yaml docker-compose.override.yml docker-compose.override.yaml terraform.tfvars
terraform.tfvars.json .terraform.tfvars values.yaml values.yml helm-values.yaml vault.yaml vault.yml
""".split()
REDUCED_FOLDERS = "tests? __tests__ specs? mocks? fixtures? examples? docs? documentation samples? demos?".split()
REDUCED_EXTENSIONS = ".md .mdx .rst .txt .adoc .asciidoc".split()
REDUCED_SUFFIXES = ".test.ts .test.js .test.tsx .test.jsx .spec.ts .spec.js .spec.tsx .spec.jsx .test.py _test.go _test.rs".split()
#: Level, its number and the factor it puts on scores.
RISKS = {"EXCLUDED": (-1, 0.0), "REDUCED": (0, 0.5), "NORMAL": (1, 1.0), "ELEVATED": (2, 1.2), "HIGH": (3, 1.4)}
#: Language of a file by its extension.
LANGUAGES = {
    ".ts": "typescript", ".tsx": "typescriptreact", ".js": "javascript", ".jsx": "javascriptreact", ".py": "python", ".go": "go", ".rs": "rust", ".java": "java", ".cs": "csharp", ".php": "php",
    ".rb": "ruby", ".sh": "shellscript", ".bash": "shellscript", ".yaml": "yaml", ".yml": "yaml", ".json": "json", ".toml": "toml", ".env": "dotenv", ".properties": "properties",
}

# --- lines --------------------------------------------------------------------------------------
LANGUAGE_KEYWORDS = """
const let var function class return import export from require default new this typeof instanceof if else for while do switch case break continue
try catch finally throw async await void null undefined true false static public private protected readonly interface type enum extends implements
def lambda with as pass del not and or in is global nonlocal yield raise assert except elif
func package struct impl use mod pub fn mut match trait where
""".split()
#: Line types in order of precedence; \w is ASCII.
LINE_TYPES = [
    ("COMMENT", [r"^\s*//", r"^\s*/\*", r"^\s*\*", r"^\s*#", r"^\s*--", r"^\s*<!--", r'^\s*"""', r"^\s*'''"]),
    ("IMPORT", [r"^\s*import\s+", r"^\s*from\s+\S+\s+import", r"^\s*(const|let|var)\s+\S+\s*=\s*require\s*\(", r"^\s*use\s+\S+", r"^\s*#include\s*"]),
    ("RETURN_STATEMENT", [r"^\s*return\s+", r"^\s*yield\s+"]),
    ("ASSIGNMENT", [r"^\s*(const|let|var)\s+\w+\s*[:=]", r"^\s*\w+\s*=\s*", r"^\s*\w+\s*:=\s*", r"^\s*(private|public|protected|static|final|readonly)\s+", r"^\s*\w+\s*:\s*\w+\s*="]),
    ("OBJECT_PROPERTY", [r"""^\s*["']?\w+["']?\s*:\s*""", r"^\s*\w+\s*=\s*[^=]"]),
    ("ARRAY_ELEMENT", [r"^\s*[\[,]", r"\[\s*\z"]),
    ("FUNCTION_ARGUMENT", [r"\w\s*\(", r"=>\s*\{"]),
]

# --- reductions: name, pattern, factor ----------------------------------------------------------
PLACEHOLDERS = [
    ("angle-bracket-template", r"^<[^>]{1,100}>\z", 0.02),
    ("square-bracket-template", r"^\[[^\]]{1,100}\]\z", 0.02),
    ("curly-brace-template", r"^\{[^}]{1,100}\}\z", 0.02),
    ("shell-variable", r"^\$\{?[A-Z_][A-Z0-9_]*\}?\z", 0.02),
    ("contains-example", r"(?i)\b(example|sample|placeholder|dummy|fake|mock|stub|fixture)\b", 0.05),
    ("your-or-my-prefix", r"(?i)\b(your|my|the|our|enter|insert|provide|put|add)[-_\s]?(api[-_]?key|token|secret|password|credential|key)\b", 0.03),
    ("changeme", r"(?i)\b(change[-_]?me|replace[-_]?me|todo|fixme|update[-_]?me|fill[-_]?me|set[-_]?me)\b", 0.02),
    ("test-prefix", r"(?i)^(test|demo|dev|staging|local|fake|mock|dummy)[-_][a-z0-9_-]{1,50}\z", 0.08),
    ("all-same-char", r"^(.)\1{7,}\z", 0.01),
    ("sequential-repeat", r"(?i)^(ab|abc|abcd|123|1234){3,}\z", 0.01),
    ("x-padding", r"(?i)^x{6,}\z", 0.01),
    ("null-like", r"(?i)^(null|none|undefined|empty|blank|n/a|na|nil|void|false|true)\z", 0.01),
    ("common-test-password", r"(?i)^(password|passwd|pass|secret|admin|root|test|demo|user|qwerty|letmein|welcome|monkey|dragon|123456|password1)[\d!@#]*\z", 0.08),
    ("your-x-here", r"(?i)\b(your|the|a)\s+\w+\s+here\b", 0.02),
    ("insert-x-here", r"(?i)\b(insert|enter|add|put|place)\s+(your\s+)?\w+\s+here\b", 0.02),
    ("short-placeholder", r"(?i)^[a-z_]{2,6}\z", 0.1),
]
PLACEHOLDER_PHRASES = ["example.com", "your-domain", "example-domain", "placeholder", "// todo", "# todo", "# replace", "// replace", "/* replace"]
PLACEHOLDER_PHRASE_FACTOR = 0.15
FORMATS = [
    ("uuid-v4", r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\z", 0.04),
    ("uuid-generic", r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z", 0.06),
    ("git-sha-full", r"(?i)^[0-9a-f]{40}\z", 0.05),
    ("git-sha-short", r"(?i)^[0-9a-f]{7,12}\z", 0.3),
    ("sha256-hash", r"(?i)^[0-9a-f]{64}\z", 0.15),
    ("sha512-hash", r"(?i)^[0-9a-f]{128}\z", 0.1),
    ("md5-hash", r"(?i)^[0-9a-f]{32}\z", 0.25),
    ("bcrypt-output", r"^\$2[aby]\$\d{2}\$.{53}\z", 0.04),
    ("argon2-output", r"^\$argon2(i|d|id)\$v=\d+\$", 0.04),
    ("sri-hash", r"^sha(256|384|512)-[A-Za-z0-9+/]+=*\z", 0.03),
    ("npm-integrity", r"^sha\d+-[A-Za-z0-9+/]+=*\z", 0.03),
    ("css-color-hex", r"(?i)^#([0-9a-f]{3}|[0-9a-f]{4}|[0-9a-f]{6}|[0-9a-f]{8})\z", 0.02),
    ("email-address", r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\z", 0.1),
    ("ipv4-address", r"^(\d{1,3}\.){3}\d{1,3}\z", 0.05),
    ("ipv6-address", r"(?i)^([0-9a-f]{1,4}:){7}[0-9a-f]{1,4}\z", 0.05),
    ("mac-address", r"(?i)^([0-9a-f]{2}:){5}[0-9a-f]{2}\z", 0.04),
    ("cidr-notation", r"^(\d{1,3}\.){3}\d{1,3}/\d{1,2}\z", 0.04),
    ("semver", r"(?i)^v?\d+\.\d+\.\d+(-[a-z0-9.+]+)?\z", 0.03),
    ("build-hash", r"(?i)^\d+\.\d+\.\d+\+[a-z0-9]+\z", 0.04),
    ("base64-very-short", r"^[A-Za-z0-9+/]{4,16}={0,2}\z", 0.25),
    ("full-url", r"""^https?://[^\s"']{10,}\z""", 0.15),
    ("template-expression", r"\$\{[^}]+\}|%\([^)]+\)s|\{\{[^}]+\}\}", 0.1),
    ("percent-encoded", r"(?i)^(%[0-9a-f]{2}){4,}\z", 0.1),
    ("hex-color-without-hash", r"(?i)^[0-9a-f]{6}\z", 0.35),
]

# --- allowlists ---------------------------------------------------------------------------------
INLINE_MARKS = [r"(?i)leakscan-ignore", r"(?i)nosec\b", r"(?i)noqa\b", r"(?i)pragma:\s*allowlist\s+secret", r"(?i)gitleaks:allow"]
GLOBAL_PATTERNS = [
    r"(?i)\b(localhost|127\.0\.0\.1|0\.0\.0\.0)\b", r"(?i)\b(example\.com|example\.org|example\.net|example\.io)\b", r"(?i)\b(test\.example|dev\.example|staging\.example)\b",
    r"\$\{[^}]+\}", r"\{\{[^}]+\}\}", r"%\([^)]+\)s", r"<[A-Z_]+>",
]
GLOBAL_STOPWORDS = "example sample placeholder dummy fake test demo mock stub fixture changeme replaceme fillme setme todo fixme xxx yyy aaa insert enter put".split()
DEVELOPER_STOPWORDS = """
example sample placeholder dummy fake mock stub fixture test demo your mine changeme change-me replace-me replaceme insert-here inserthere todo fixme
xxx yyy zzz aaa bbb ccc 1234 abcd n/a na none null undefined empty blank
""".split()

# --- layers -------------------------------------------------------------------------------------
DISTANCE_WEIGHTS = [1.0, 0.8, 0.6, 0.4, 0.2, 0.1]
BROAD_GROUPS = ["Generic Secrets", "Common Aliases & Casings"]
SPECIFIC_GROUPS = ["AWS", "Azure", "Google Cloud Platform", "OpenAI", "Anthropic", "Stripe", "GitHub", "GitLab", "Certificates", "Databases", "OAuth & Social"]
AUTH_STRINGS = [
    "authorization", "bearer", "token", "api-key", "x-api-key", "x-auth-token", "x-access-token", "oauth", "oauth2", "jwt", "basic auth", "digest", "authentication", "credentials", "secret", "private",
    "access-token", "refresh-token", "id-token", "api_key", "auth_token", "client_secret", "client_id", "grant_type", "client_credentials",
]
PROVIDER_STRINGS = """
openai anthropic aws amazon google azure microsoft stripe paypal braintree github gitlab bitbucket slack discord telegram twilio sendgrid mailgun
firebase supabase mongodb postgresql mysql redis cloudflare datadog sentry okta auth0 cognito keycloak vault hashicorp vercel netlify heroku
railway render fly.io digitalocean
""".split()
HTTP_STRINGS = "content-type application/json headers fetch axios request post get put delete patch http https endpoint baseurl base_url api_url".split()

# --- rules --------------------------------------------------------------------------------------
#: Words of a rule's id that say nothing about its values.
COMMON_PARTS = """
a an the of for and or in on to api key token secret access auth user id file password passwd url uri endpoint service account config value name
string credential cred
""".split()

# --- scores -------------------------------------------------------------------------------------
WEIGHTS = {"regex": 0.35, "entropy": 0.20, "context": 0.20, "string_group": 0.15, "file_context": 0.10}
#: Severity, its rank and the least score.
SEVERITIES = [("critical", 5, 0.88), ("high", 4, 0.75), ("medium", 3, 0.65), ("low", 2, 0.55), ("informational", 1, 0.40)]
#: How an editor marks each severity, and the theme's colour for it.
MARKER_LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "information", "informational": "hint"}
MARKER_COLORS = {"critical": "errorForeground", "high": "charts.orange", "medium": "charts.yellow", "low": "charts.green", "informational": "charts.blue"}
BLOCKING = {"critical": True, "high": True, "medium": False, "low": False, "informational": False}
SHORTEST, LONGEST = 8, 512
RECOMMENDED_IGNORES = ".env .env.local .env.*.local .env.production .env.staging .env.development *.pem *.key *.p12 *.pfx secrets.json credentials.json service-account.json .netrc".split()
