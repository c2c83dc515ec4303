"""Column functions on names, paths, lines and definitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Separators that part the tokens of a definition.
SEPARATORS = "\n\r\t (),;.=<>+-*/%!?[]{}|&^~:'\"`@#\\"
# Directories and files that a tree scan leaves out.
SKIP_DIRS = [".git", ".svn", ".hg", "node_modules", "target", "build", "dist", "out", ".idea", ".vscode", "__pycache__", ".gradle", ".mvn", "bin", "obj", "venv", ".venv", "env", "vendor", "coverage", ".pytest_cache"]
SKIP_FILES = [".DS_Store", "Thumbs.db", "vssver.scc"]
# File types by extension and by whole name.
TYPE_BY_EXTENSION = {
    ".java": "java", ".kt": "kotlin", ".kts": "kotlin", ".scala": "scala", ".groovy": "groovy", ".py": "python", ".rb": "ruby", ".php": "php", ".go": "go", ".rs": "rust", ".swift": "swift", ".cs": "csharp", ".c": "c", ".h": "c",
    ".cpp": "cpp", ".cc": "cpp", ".hpp": "cpp", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".vue": "vue", ".sql": "sql", ".xml": "xml", ".xhtml": "xml", ".html": "html", ".htm": "html",
    ".css": "css", ".scss": "scss", ".sass": "sass", ".less": "less", ".json": "json", ".yml": "yaml", ".yaml": "yaml", ".toml": "toml", ".properties": "properties", ".gradle": "gradle", ".md": "markdown", ".sh": "shell", ".bat": "batch", ".ps1": "powershell",
}
TYPE_BY_NAME = {"pom.xml": "maven", "build.gradle": "gradle", "build.gradle.kts": "gradle", "Dockerfile": "docker", "Makefile": "make", "requirements.txt": "pip"}
# Extensions by how their lines are told apart.
BRACE_FAMILY = [".java", ".kt", ".kts", ".scala", ".groovy", ".c", ".h", ".cpp", ".cc", ".hpp", ".cs", ".go", ".rs", ".swift", ".js", ".jsx", ".ts", ".tsx", ".php"]
HASH_FAMILY = [".py", ".rb", ".sh", ".yml", ".yaml", ".properties", ".toml"]
MARKUP_FAMILY = [".xml", ".xhtml", ".html", ".htm"]
STYLE_FAMILY = [".css", ".scss", ".sass", ".less"]


def definition_tokens(c: str | Column) -> Column:
    """Lower-cased text with every separator turned into a blank and a blank at both ends."""
    c = F.col(c) if isinstance(c, str) else c
    return F.concat(F.lit(" "), F.translate(F.lower(c), SEPARATORS, " " * len(SEPARATORS)), F.lit(" "))


def matches_table(definition: str | Column, name: str | Column, least: int = 4) -> Column:
    """Whether a definition holds a table's name as a whole token; names that are short or hold a separator other than a blank never match."""
    n = F.lower(F.col(name) if isinstance(name, str) else name)
    bare = F.translate(n, SEPARATORS.replace(" ", ""), "\u0001" * (len(SEPARATORS) - 1)).contains("\u0001")
    return F.coalesce((F.char_length(n) >= least) & ~bare & definition_tokens(definition).contains(F.concat(F.lit(" "), n, F.lit(" "))), F.lit(False))


def file_type(name: str | Column) -> Column:
    """Type of a file: whole names first, then the lower-cased extension; null if neither is known."""
    name = F.col(name) if isinstance(name, str) else name
    lookup = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    return F.coalesce(F.get(F.map_values(F.map_filter(lookup(TYPE_BY_NAME), lambda k, v: k == name)), F.lit(0)), F.element_at(lookup(TYPE_BY_EXTENSION), F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))))


def kept_path(path: str | Column) -> Column:
    """Whether a scan keeps the path: no skipped directory above it, not a skipped file."""
    path = F.col(path) if isinstance(path, str) else path
    parts = F.split(path, "/")
    above = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return ~F.arrays_overlap(above, F.array(*map(F.lit, SKIP_DIRS))) & ~F.element_at(parts, -1).isin(*SKIP_FILES)


def line_kind(line: str | Column, extension: str | Column) -> Column:
    """blank, comment, import, package, annotation, export or code, by the family of the extension."""
    s = F.regexp_replace(F.col(line) if isinstance(line, str) else line, r"^\s+|\s+$", "")
    e = F.col(extension) if isinstance(extension, str) else extension
    begins = lambda *p: F.rlike(s, F.lit("^(?:" + "|".join(p) + ")"))
    brace, hashed = e.isin(*BRACE_FAMILY), e.isin(*HASH_FAMILY)
    # what is trimmed loses its last blank, so a bare "import" is code
    return (
        F.when(F.coalesce(s, F.lit("")) == "", "blank")
        .when(brace & begins("//", r"/?\*"), "comment").when(brace & begins("import ", "#include"), "import").when(brace & begins("package "), "package").when(brace & begins("@"), "annotation").when(brace & begins("export "), "export")
        .when(hashed & begins("#"), "comment").when((e == ".py") & begins("import ", "from "), "import")
        .when(e.isin(*MARKUP_FAMILY) & begins("<!--"), "comment").when(e.isin(*STYLE_FAMILY) & begins(r"/\*", "//"), "comment").otherwise("code")
    )


def strip_credentials(url: str | Column) -> Column:
    """An address without the password it holds.

    Addresses with a scheme lose all that stands before the host: a password may hold ``@``, ``/``, ``?`` and ``#``, so
    the last ``@`` that a host follows counts. Over ssh the user alone belongs to the address and stays. Without
    a scheme (``git@host:path``) only ``user:password@`` loses its password.
    """
    url = F.col(url) if isinstance(url, str) else url
    scheme = F.lower(F.regexp_extract(url, r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    rest = F.regexp_replace(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://", "")
    head = F.regexp_extract(url, r"^(\s*[A-Za-z][A-Za-z0-9+.-]*://)", 1)
    # user information up to the first slash, or, where that is no host, further on: user:pa/ss@host
    plain = F.regexp_extract(rest, r"^([^/?#]*)@", 1)
    user = F.when(plain != "", plain).otherwise(F.regexp_extract(rest, r"^([^/?#@:\s]*:[^@\s]*)@[A-Za-z0-9\[][^@]*$", 1))
    bare = F.when(user == "", url).when(scheme.isin("ssh", "git+ssh", "ssh+git"), F.concat(head, F.regexp_extract(user, r"^([^:]*)", 1), F.lit("@"), F.substr(rest, F.length(user) + 2))).otherwise(F.concat(head, F.substr(rest, F.length(user) + 2)))
    return F.when(scheme == "", F.regexp_replace(url, r"^([^:@/\s]+):[^@/\s]*@", "$1@")).otherwise(bare)


def caption(name: Column, node_id: Column) -> Column:
    """Name of a node, else what follows the last of ``# / \\ :`` in its id, else the id."""
    tail = F.regexp_extract(node_id, r"[^#/\\:]+$", 0)
    return F.coalesce(F.nullif(name, F.lit("")), F.nullif(tail, F.lit("")), node_id)


def author_id(email: str | Column, name: str | Column) -> Column:
    email, name = (F.col(x) if isinstance(x, str) else x for x in (email, name))
    return F.lower(F.coalesce(F.nullif(email, F.lit("")), name))
