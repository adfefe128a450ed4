"""Word lists and names whose contents decide results. They are data, and stand in reading order."""

# Words without meaning in a question, English and Portuguese.
STOPWORDS = (
    "a an the is are was were be been do does did how what which who whom whose where when why "
    "in on at to of for from by with and or not it its this that these those as into about "
    "i you we they he she can could should would will may might there their them me my our your "
    "o os as um uma de do da dos das em no na nos nas por para com e ou que como qual "
    "quais onde quando ao aos se ser foi sao"
).split()

# Words that only make a question of its subject.
FILLER = (
    "what whats which who whom where when how why does do did is are was "
    "were the a an of to in on at for and or it this that with by "
    "uses use used using calls call called depends depend depending works work "
    "show me find list all can you about from into as be "
    "qual quais quem onde como por que porque o os as um uma de da do "
    "das dos em no na nos nas usa usam usado chama chamam depende dependem "
    "funciona mostre liste e ou para com"
).split()

# Phrases that ask who depends on something.
DEPENDENT_PHRASES = (
    "uses", "used by", "users of", "who calls", "callers", "caller of", "depends on", "dependents", "depend on",
    "impact", "references", "referenced", "imports", "importers", "imported by", "who uses", "what uses",
    "quem usa", "quem chama", "quem depende", "usado por", "depende de", "dependentes", "impacto",
)

# Extensions and names of files that are no source material.
NOISE_EXTENSIONS = (
    "png jpg jpeg gif webp ico bmp tiff svg pdf woff woff2 ttf otf eot zip gz tgz bz2 xz 7z rar jar exe dll so dylib "
    "bin wasm onnx mp3 mp4 mov wav avi webm sqlite db lock"
).split()
NOISE_NAMES = ("package-lock.json", "pnpm-lock.yaml", "yarn.lock", "Cargo.lock", "composer.lock")

# Names before a hard-coded credential, and what tells a reference from a literal.
CREDENTIAL_NAMES = ("password", "passwd", "secret", "api_key", "apikey", "api-key", "private_key", "access_token", "auth_token", "client_secret")
CREDENTIAL_REFERENCES = ("${", "process.env", "os.environ", "{{", "[REDACTED")

# Spellings of one SQL type.
SQL_TYPES = {
    "character varying": "varchar", "character": "char", "bpchar": "char", "integer": "int", "int4": "int", "int8": "bigint",
    "int2": "smallint", "bool": "boolean", "timestamp with time zone": "timestamptz",
    "timestamp without time zone": "timestamp", "time with time zone": "timetz", "time without time zone": "time",
    "float8": "double precision", "float4": "real", "decimal": "numeric",
}

# Relations by code, and the contexts of an edge.
RELATIONS = (
    "satisfies", "depends_on", "implements", "defined_in", "co_changes", "imports", "re_exports", "calls", "instantiates",
    "extends", "references", "annotated_by", "similar_to",
)
CONTEXTS = ("runtime", "type_only", "test", "spec", "annotation", "embedding")

# Languages by extension, in which symbols are looked for.
LANGUAGES = {"ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "go": "go", "rs": "rust"}

# Names of files with keys, of generated files, of folders that are skipped, and extensions worth a summary.
ELIGIBLE_EXTENSIONS = ("ts", "tsx", "js", "jsx", "mjs", "cjs", "py", "go", "rs", "md")
SKIPPED_FOLDERS = (".git", ".specs/.index", ".specs/.cache", ".models", "target", "node_modules", "dist", "build", "coverage", ".next", "vendor")

# Fixed patterns of tokens that are secrets, by kind, in the order in which they are tried.
SECRET_TOKENS = {
    "AWS access key": "AKIA[A-Z0-9]{16}",
    "Google API key": "AIza[A-Za-z0-9_-]{35,}",
    "GitHub token": "(?:gh[pos]_[A-Za-z0-9_-]{30,}|github_pat_[A-Za-z0-9_-]{30,})",
    "API secret key": "sk-[A-Za-z0-9_-]{20,}",
    "Slack token": "xox[baprs][A-Za-z0-9_-]{17,}",
}

# First segments of endpoints that tell no service.
GENERIC_SEGMENTS = ("health", "healthz", "status", "ping", "metrics", "ready", "live", "version", "login", "logout")

# Receivers whose methods are HTTP calls.
HTTP_RECEIVERS = ("axios", "http", "httpclient", "client", "api", "request", "requests", "got", "ky", "httpx", "session", "fetcher")
