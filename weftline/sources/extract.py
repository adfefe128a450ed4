"""Extractors: rows from source texts. Pure functions of a text, and one way to run them over (path, content)."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.words import HTTP_RECEIVERS

MARKER = re.compile(r"(REQ|TASK|ADR)-(?:[A-Z][A-Z0-9]*-)*[0-9]+[a-z]?")
MAX_BODY = 800


def over(files: DataFrame, extract: Callable[[str, str], list[tuple]], schema: str) -> DataFrame:
    """extract(path, content) over every file; columns by schema, which begins with path. Files with no text give none."""
    names = [c.strip().split(" ")[0] for c in re.split(r",(?![^<]*>)", schema)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, *row) for p, t in zip(f["path"], f["content"], strict=True) if t is not None for row in extract(p, t)]
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, schema)


# --- Markdown -----------------------------------------------------------------------------------------------------


def markdown(path: str, text: str) -> list[tuple]:
    """(kind, marker, title, body, satisfies): REQ list items and headings, TASK and ADR headings.

    A parenthesised label before the colon joins the body. Text after a heading is its body, up to MAX_BODY
    characters. A task's or decision's text satisfies every requirement that it mentions, known or not.
    """
    found: list[dict] = []
    open_: dict | None = None
    fenced = False
    for line in text.split("\n"):
        if line.lstrip().startswith("```"):
            fenced = not fenced
            continue
        if fenced:
            continue
        heading = re.match(r"#{1,6}\s+(.*)", line)
        item = re.match(r"\s*(?:[-*+]|[0-9]+[.)])\s+(?:\[[ xX]\]\s+)?(.*)", line)
        plain = re.sub(r"[*_`]", "", (heading or item).group(1)).strip() if heading or item else ""
        m = MARKER.match(plain)
        if m and (heading or m[1] == "REQ"):
            rest = plain[m.end() :].strip()
            label = re.match(r"\(([^)]*)\)\s*", rest)
            rest = rest[label.end() :] if label else rest
            rest = rest.lstrip(":—–- ").strip()
            body = f"{label[1]} {rest}".strip() if label else rest
            now = {"kind": {"REQ": "requirement", "TASK": "task", "ADR": "adr"}[m[1]], "marker": m[0], "title": rest if heading else m[0], "body": [] if heading else [body], "req": set()}
            if heading and label:
                now["body"].append(label[1])
            found.append(now)
            open_ = now if heading else open_
            source = now if now["kind"] != "requirement" else None
        elif heading:
            open_, source = None, None
        else:
            source = open_
            if open_ is not None and line.strip():
                open_["body"].append((item.group(1) if item else line).strip())
        if source is not None and source["kind"] != "requirement":
            source["req"] |= {x[0] for x in MARKER.finditer(line) if x[1] == "REQ"}
    return [(d["kind"], d["marker"], d["title"], " ".join(d["body"])[:MAX_BODY], sorted(d["req"])) for d in found]


MARKDOWN = "path string, kind string, marker string, title string, body string, satisfies array<string>"


# --- code ---------------------------------------------------------------------------------------------------------

_OPENERS = {
    "rust": r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+|extern\s+\"[^\"]*\"\s+)*(?:fn|struct|enum|trait)\s+([A-Za-z_]\w*)",
    "go": r"^func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)|^type\s+([A-Za-z_]\w*)",
    "javascript": r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function\s*\*?|class)\s+([A-Za-z_$][\w$]*)|^[ \t]+(?:static\s+|async\s+|get\s+|set\s+)*(?!(?:if|for|while|switch|catch|return|function)\b)([A-Za-z_$][\w$]*)\s*\([^)]*\)\s*\{",
    "typescript": r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:function\s*\*?|class|interface|enum|type)\s+([A-Za-z_$][\w$]*)|^[ \t]+(?:public\s+|private\s+|protected\s+|static\s+|readonly\s+|async\s+|get\s+|set\s+)*(?!(?:if|for|while|switch|catch|return|function)\b)([A-Za-z_$][\w$]*)\s*(?:<[^>]*>)?\([^)]*\)\s*(?::\s*[^{;=]+)?\{",
}
_OPENERS["tsx"] = _OPENERS["typescript"]
_LANGUAGE = {"ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "go": "go", "rs": "rust"}


def language_of(path: str) -> str | None:
    return _LANGUAGE.get(path.rsplit(".", 1)[-1].lower()) if "." in path else None


def blanked(text: str) -> str:
    """The text with comments and string contents as spaces, of the same length, so that offsets hold."""
    out = re.sub(r"//[^\n]*|/\*.*?\*/", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)
    return re.sub(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", lambda m: m[0][0] + re.sub(r"[^\n]", " ", m[0][1:-1]) + m[0][-1], out, flags=re.S)


def _end(clean: str, at: int) -> int:
    """After the braces that open from here on, or after the statement if none do."""
    depth, i = 0, at
    while i < len(clean):
        c = clean[i]
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth <= 0:
                return i + 1
        elif c == ";" and not depth:
            return i + 1
        i += 1
    return len(clean)


def _comment_before(text: str, start: int) -> str:
    """The comment that stands directly before an offset."""
    head = text[:start].rstrip()
    if head.endswith("*/"):
        return head[head.rfind("/*") :]
    lines = []
    for line in reversed(head.split("\n")):
        if not re.match(r"\s*(//|#|@)", line):
            break
        lines.append(line)
    return "\n".join(reversed(lines))


def symbols(path: str, text: str) -> list[tuple]:
    """(name, ordinal, start, end, line_start, line_end, satisfies): functions, classes and types of a file.

    Lines are 0-based and inclusive; ordinal counts homonyms in the file; satisfies are the requirements and
    decisions named in the comment just before. Texts that can't be parsed give no rows.
    """
    lang = language_of(path)
    found: list[tuple[int, int, str]] = []
    if lang == "python":
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError):
            return []
        starts = [0]
        for line in text.split("\n"):
            starts.append(starts[-1] + len(line) + 1)
        lines = text.split("\n")
        place = lambda row, byte: starts[row - 1] + len(lines[row - 1].encode()[:byte].decode("utf-8", "ignore"))
        for node in ast.walk(tree):
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                found.append((place(node.lineno, node.col_offset), place(node.end_lineno, node.end_col_offset), node.name))
    elif lang:
        clean = blanked(text)
        for m in re.finditer(_OPENERS[lang], clean, re.M):
            name = next(g for g in m.groups() if g)
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            found.append((start, _end(clean, m.end() - m[0].endswith("{")), name))
    out, seen = [], {}
    for start, end, name in sorted(found):
        ordinal = seen[name] = seen.get(name, -1) + 1
        marks = sorted({m[0] for m in MARKER.finditer(_comment_before(text, start)) if m[1] != "TASK"})
        out.append((name, ordinal, start, end, text.count("\n", 0, start), text.count("\n", 0, max(start, end - 1)), marks))
    return out


SYMBOLS = "path string, name string, ordinal int, start int, end int, line_start int, line_end int, satisfies array<string>"


def calls(path: str, text: str) -> list[tuple]:
    """(name, at): direct calls of an identifier, for joins with the symbols of the file."""
    lang = language_of(path)
    if not lang:
        return []
    clean = re.sub(r"#[^\n]*", lambda m: " " * len(m[0]), text) if lang == "python" else blanked(text)
    return [(m[1], m.start(1)) for m in re.finditer(r"(?<![\w.$])([A-Za-z_$][\w$]*)\s*\(", clean) if not re.search(r"(?:\b(?:def|class|fn|func|function))\s+$", clean[max(0, m.start() - 12) : m.start(1)])]


CALLS = "path string, name string, at int"


def imports(path: str, text: str) -> list[tuple]:
    """(specifier, kind, type_only, bindings): static, dynamic, required and re-exported modules, once each."""
    lang = language_of(path)
    out: list[tuple] = []
    if lang in ("typescript", "tsx", "javascript"):
        code = re.sub(r"//[^\n]*|/\*.*?\*/", " ", text, flags=re.S)
        pairs = lambda s: [" as ".join(x.strip() for x in b.removeprefix("type ").split(" as ")) for b in map(str.strip, s.split(",")) if b]
        named = lambda s: [b.split(" as ")[0].strip().removeprefix("type ") for b in s.split(",") if b.strip()]
        for m in re.finditer(r"\b(import|export)\s+(type\s+)?((?:[^'\";]|\n)*?)\bfrom\s*(['\"])(.*?)\4", code):
            what, bindings = m[3], []
            if braces := re.search(r"\{([^}]*)\}", what):
                bindings += pairs(braces[1]) if m[1] == "export" else named(braces[1])
            if "*" in what:
                bindings.append("*")
            if m[1] == "import" and (first := re.match(r"\s*([A-Za-z_$][\w$]*)\s*(,|$)", what)):
                bindings.append("default")
                del first
            out.append((m[5], "reexport" if m[1] == "export" else "static", bool(m[2]), bindings))
        out += [(m[2], "static", False, []) for m in re.finditer(r"\bimport\s*(['\"])(.*?)\1", code)]
        out += [(m[2], "dynamic", False, ["*"]) for m in re.finditer(r"\bimport\s*\(\s*(['\"])(.*?)\1\s*\)", code)]
        out += [(m[2], "require", False, ["*"]) for m in re.finditer(r"\brequire\s*\(\s*(['\"])(.*?)\1\s*\)", code)]
    elif lang == "python":
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError):
            return []
        for node in ast.walk(tree):
            if isinstance(node, ast.Import):
                out += [(a.name, "static", False, ["*"]) for a in node.names]
            elif isinstance(node, ast.ImportFrom):
                out.append(("." * node.level + (node.module or ""), "static", False, [a.name for a in node.names]))
    elif lang == "rust":
        code = blanked(text)
        for m in re.finditer(r"\buse\s+([^;]+);", code):
            out += [(p, "static", False, [p.rsplit("::", 1)[-1]]) for p in _use(re.sub(r"\s+", " ", m[1]).strip())]
        out += [(f"mod {m[1]}", "static", False, ["*"]) for m in re.finditer(r"^\s*(?:pub\s+)?mod\s+(\w+)\s*;", code, re.M)]
    elif lang == "go":
        for m in re.finditer(r"\bimport\s*(?:\(([^)]*)\)|(?:[\w.]+\s+)?\"([^\"]+)\")", text):
            out += [(s, "static", False, ["*"]) for s in (re.findall(r"\"([^\"]+)\"", m[1]) if m[1] else [m[2]])]
    return list({(s, k, t, tuple(b)): (s, k, t, b) for s, k, t, b in out}.values())


def _use(tree: str) -> list[str]:
    """The paths of a use tree."""
    m = re.match(r"^(.*?)\{(.*)\}$", tree)
    if not m:
        return [re.sub(r"\s+as\s+\w+$", "", tree).strip()]
    parts, depth, own = [], 0, ""
    for c in m[2] + ",":
        depth += (c == "{") - (c == "}")
        if c == "," and not depth:
            parts.append(own.strip())
            own = ""
        else:
            own += c
    return [p for part in parts if part for p in ([m[1].rstrip(":")] if part == "self" else _use(m[1] + part))]


IMPORTS = "path string, specifier string, kind string, type_only boolean, bindings array<string>"


def signature(path: str, text: str) -> str:
    """A symbol's text with its body left out; the text itself where there is none."""
    if language_of(path) == "python":
        try:
            node = ast.parse(text).body[0]
            body = node.body[0]
        except (SyntaxError, ValueError, IndexError, AttributeError):
            return text
        lines = text.split("\n")
        return "\n".join(lines[: body.lineno - 1]) + f"\n{' ' * body.col_offset}..." if body.lineno > 1 else text
    clean = blanked(text)
    at = clean.find("{")
    return text[:at].rstrip() + " { ... }" if at >= 0 else text


# --- data definitions ---------------------------------------------------------------------------------------------


def _statements(sql: str) -> list[str]:
    clean = re.sub(r"--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S)
    out, own, quote, depth = [], "", None, 0
    for c in clean:
        if quote:
            quote = None if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
        if c == ";" and not quote and depth <= 0:
            out.append(own.strip())
            own = ""
        else:
            own += c
    return [s for s in [*out, own.strip()] if s]


def _split(inner: str) -> list[str]:
    parts, depth, own, quote = [], 0, "", None
    for c in inner + ",":
        if quote:
            quote = None if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
        if c == "," and not depth and not quote:
            parts.append(own.strip())
            own = ""
        else:
            own += c
    return [p for p in parts if p]


def _name(raw: str) -> tuple[str, str]:
    parts = [p.strip('"`[] ') for p in raw.split(".")]
    return (parts[-2], parts[-1]) if len(parts) > 1 else ("public", parts[-1])


_N = r"((?:[\w\"`\[\]]+\.)?[\w\"`\[\]]+)"


def ddl(path: str, sql: str) -> list[tuple]:
    """(seq, action, schema, table, name, detail, nullable): an ordered log of what a script does to a schema.

    Actions: table, view, column, drop_column, alter_column, rename_column, constraint, index, drop, rename; a
    statement of another kind is one 'unknown' row. detail holds a type, columns, a target or a new name.
    """
    out: list[tuple] = []

    def add(action, schema, table, name=None, detail=None, nullable=None) -> None:
        out.append((len(out), action, schema, table, name, detail, nullable))

    def constraint(schema: str, table: str, part: str, at: int = 0) -> bool:
        named = re.match(r"(?is)constraint\s+([\w\"`]+)\s+(.*)", part)
        name, rest = (named[1].strip('"`'), named[2]) if named else (None, part)
        for kind, pattern in (("primary_key", r"primary\s+key\s*\(([^)]*)\)"), ("foreign_key", r"foreign\s+key\s*\(([^)]*)\)\s*references\s+" + _N), ("unique", r"unique\s*(?:key|index)?\s*\w*\s*\(([^)]*)\)"), ("check", r"check\s*\((.*)\)")):
            m = re.match("(?is)" + pattern, rest)
            if m:
                target = "→" + ".".join(_name(m[2])) if kind == "foreign_key" else ""
                add("constraint", schema, table, name or f"{table}_{kind}_{at}", f"{kind}:{re.sub(r'[\s\"`]', '', m[1])}{target}")
                return True
        return False

    def column(schema: str, table: str, part: str) -> None:
        m = re.match(r"(?is)([\w\"`\[\]]+)\s+(.*)", part)
        if not m:
            return
        name, rest = m[1].strip('"`[]'), m[2]
        stop = re.search(r"(?i)\b(not\s+null|null|default|primary\s+key|unique|references|check|constraint|generated|collate|auto_increment|comment)\b", rest)
        kind = re.sub(r"\s+", " ", rest[: stop.start()] if stop else rest).strip()
        key = bool(re.search(r"(?i)\bprimary\s+key\b", rest))
        add("column", schema, table, name, kind, not (key or re.search(r"(?i)\bnot\s+null\b", rest)))
        if key:
            add("constraint", schema, table, f"{table}_pkey", f"primary_key:{name}")
        if re.search(r"(?i)\bunique\b", rest):
            add("constraint", schema, table, f"{table}_{name}_key", f"unique:{name}")
        if ref := re.search(r"(?i)\breferences\s+" + _N, rest):
            add("constraint", schema, table, f"{table}_{name}_fkey", f"foreign_key:{name}→{'.'.join(_name(ref[1]))}")

    for s in _statements(sql):
        flat = re.sub(r"\s+", " ", s)
        if m := re.match(rf"(?is)create\s+(?:(?:global|local)\s+)?(?:temp(?:orary)?\s+|unlogged\s+)?table\s+(?:if\s+not\s+exists\s+)?{_N}\s*\((.*)\)", s):
            schema, table = _name(m[1])
            add("table", schema, table)
            for k, part in enumerate(_split(m[2])):
                if not constraint(schema, table, part, k):
                    column(schema, table, part)
        elif m := re.match(rf"(?is)create\s+(?:or\s+replace\s+)?(?:materialized\s+)?view\s+(?:if\s+not\s+exists\s+)?{_N}.*?\bas\b(.*)", s):
            add("view", *_name(m[1]), None, ",".join(sorted({".".join(_name(x)) for x in re.findall(rf"(?i)\b(?:from|join)\s+{_N}", m[2])})))
        elif m := re.match(rf"(?i)create (unique )?index (?:concurrently )?(?:if not exists )?{_N} on (?:only )?{_N}(?: using \w+)? ?\((.*)\)", flat):
            schema, table = _name(m[3])
            columns = ",".join(x.split()[0].strip('"') for x in _split(m[4]))
            add("index", schema, table, _name(m[2])[1], f"{'unique_index' if m[1] else 'index'}:{columns}")
        elif m := re.match(rf"(?i)drop (table|view|materialized view|index) (?:if exists )?{_N}", flat):
            add("drop", *_name(m[2]), None, m[1].lower())
        elif m := re.match(rf"(?i)alter table (?:if exists )?(?:only )?{_N} (.*)", flat):
            schema, table = _name(m[1])
            for part in _split(m[2]):
                if x := re.match(r"(?i)rename to ([\w\"`]+)", part):
                    add("rename", schema, table, None, x[1].strip('"`'))
                elif x := re.match(r"(?i)rename (?:column )?([\w\"`]+) to ([\w\"`]+)", part):
                    add("rename_column", schema, table, x[1].strip('"`'), x[2].strip('"`'))
                elif x := re.match(r"(?i)drop constraint (?:if exists )?([\w\"`]+)", part):
                    add("drop_constraint", schema, table, x[1].strip('"`'))
                elif x := re.match(r"(?i)drop (?:column )?(?:if exists )?([\w\"`]+)", part):
                    add("drop_column", schema, table, x[1].strip('"`'))
                elif x := re.match(r"(?i)alter (?:column )?([\w\"`]+) (?:set data )?type ([^,]+?)(?: using .*)?$", part):
                    add("alter_column", schema, table, x[1].strip('"`'), x[2].strip())
                elif x := re.match(r"(?i)alter (?:column )?([\w\"`]+) (set|drop) not null", part):
                    add("alter_column", schema, table, x[1].strip('"`'), None, x[2].lower() == "drop")
                elif x := re.match(r"(?i)add (?:column )?(?:if not exists )?(.*)", part):
                    if not constraint(schema, table, x[1], len(out)):
                        column(schema, table, x[1])
        else:
            add("unknown", None, None, None, flat.split(" ")[0].lower())
    return out


DDL = "path string, seq int, action string, schema string, table string, name string, detail string, nullable boolean"


def fold_schema(actions: list[tuple]) -> dict:
    """{(schema, table): {view, columns: {name: (type, nullable)}, constraints: {name: detail}}} after all actions in order."""
    tables: dict = {}
    for action, schema, table, name, detail, nullable in actions:
        key = (schema, table)
        own = tables.get(key)
        if action in ("table", "view"):
            tables.setdefault(key, {"view": action == "view", "sources": detail if action == "view" else None, "columns": {}, "constraints": {}})
        elif action == "drop":
            if detail == "index":
                for t in tables.values():
                    t["constraints"].pop(table, None)
            else:
                tables.pop(key, None)
        elif own is None:
            continue
        elif action == "column":
            own["columns"][name] = (detail, nullable)
        elif action == "drop_column":
            own["columns"].pop(name, None)
        elif action == "alter_column" and name in own["columns"]:
            kind, was = own["columns"][name]
            own["columns"][name] = (detail or kind, was if nullable is None else nullable)
        elif action == "rename_column" and name in own["columns"]:
            own["columns"] = {detail if k == name else k: v for k, v in own["columns"].items()}
        elif action in ("constraint", "index"):
            own["constraints"][name] = detail
        elif action == "drop_constraint":
            own["constraints"].pop(name, None)
        elif action == "rename":
            tables[(schema, detail)] = tables.pop(key)
    return tables


# --- manifests, services, mappings --------------------------------------------------------------------------------


def jsonc(text: str) -> str:
    """JSON of a text with comments and trailing commas."""
    out = re.sub(r"\"(?:\\.|[^\"\\])*\"|//[^\n]*|/\*.*?\*/", lambda m: m[0] if m[0][0] == '"' else " ", text, flags=re.S)
    return re.sub(r"\"(?:\\.|[^\"\\])*\"|,(?=\s*[}\]])", lambda m: m[0] if m[0][0] == '"' else "", out, flags=re.S)


def extended(path: str, target: str) -> str:
    """The place in the tree of a file that a file names by a relative path; .json may be left out."""
    import posixpath

    return posixpath.normpath(posixpath.join(posixpath.dirname(path), target if target.endswith(".json") else f"{target}.json"))


def manifest(path: str, text: str) -> list[tuple]:
    """(kind, name, version, dependencies, extends): package.json, Cargo.toml and tsconfig files; damaged ones give none."""
    base = path.rsplit("/", 1)[-1]
    try:
        if base == "package.json":
            d = json.loads(jsonc(text))
            deps = sorted({k for field in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies") for k in d.get(field) or {}})
            return [("package", d["name"], d.get("version"), deps, None)] if d.get("name") else []
        if base == "Cargo.toml":
            import tomllib

            d = tomllib.loads(text)
            deps = sorted({k for field in ("dependencies", "dev-dependencies", "build-dependencies") for k in d.get(field, {})})
            version = d.get("package", {}).get("version")
            return [("package", d["package"]["name"], version if isinstance(version, str) else None, deps, None)] if "package" in d else []
        if re.fullmatch(r"tsconfig.*\.json", base):
            extends = json.loads(jsonc(text)).get("extends")
            return [("tsconfig", path, None, [], extended(path, x)) for x in (extends if isinstance(extends, list) else [extends]) if isinstance(x, str) and x.startswith(".")]
    except (ValueError, KeyError, AttributeError):
        return []
    return []


MANIFEST = "path string, kind string, name string, version string, dependencies array<string>, extends string"


def normalize_path(raw: str) -> str:
    """A URL's path with parameters as {}; the same rule as the column expression's."""
    text = raw.strip()
    if "://" in text:
        rest = text.split("://", 1)[1]
        text = rest[rest.index("/") :] if "/" in rest else ""
    text = re.sub(r"^\$\{[^}]*\}(?=/)", "", text)
    segments = [s for s in re.split(r"[?#]", text)[0].split("/") if s]
    return "/" + "/".join("{}" if re.match(r"[{:]|<.*>$", s) or "${" in s else s for s in segments)


_METHODS = ("get", "post", "put", "patch", "delete", "head", "options")


def openapi(path: str, text: str) -> list[tuple]:
    """(method, url, operation_id) of an OpenAPI or Swagger document, JSON or YAML."""
    try:
        if path.endswith(".json"):
            d = json.loads(text)
        else:
            import yaml

            d = yaml.safe_load(text)
    except Exception:  # a damaged document is none
        return []
    if not isinstance(d, dict) or not ("openapi" in d or "swagger" in d):
        return []
    base = d.get("basePath") or ""
    return [(m.upper(), normalize_path(base + p), (o or {}).get("operationId")) for p, ops in (d.get("paths") or {}).items() for m, o in (ops or {}).items() if m in _METHODS]


OPENAPI = "path string, method string, url string, operation_id string"


def http_calls(path: str, text: str) -> list[tuple]:
    """(method, url): calls of known clients with a literal address of at most 200 characters."""
    out = []
    for m in re.finditer(r"\bfetch\(\s*(['\"`])(.{1,200}?)\1(?:\s*,\s*\{[^}]*?method\s*:\s*['\"](\w+)['\"])?", text):
        out.append(((m[3] or "GET").upper(), normalize_path(m[2])))
    receiver = "|".join(HTTP_RECEIVERS)
    for m in re.finditer(rf"(?i:\w*(?:{receiver}))\.(get|post|put|patch|delete|head)\s*(?:<[^>]*>)?\(\s*f?(['\"`])(.{{1,200}}?)\2", text):
        out.append((m[1].upper(), normalize_path(m[3])))
    return list(dict.fromkeys(x for x in out if x[1] != "/"))


HTTP_CALLS = "path string, method string, url string"


def orm(path: str, text: str) -> list[tuple]:
    """(entity, table): mappings whose table name is a literal."""
    found = [(m[2], m[1]) for m in re.finditer(r"@Entity\(\s*(?:\{[^}]*?name\s*:\s*)?['\"]([\w.]+)['\"][^)]*\)\s*(?:@\w+\([^)]*\)\s*)*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)", text)]
    found += [(m[2], m[1]) for m in re.finditer(r"@Table\(\s*\{[^}]*?tableName\s*:\s*['\"]([\w.]+)['\"][^)]*\)\s*(?:export\s+)?(?:default\s+)?class\s+(\w+)", text)]
    found += [(m[1], m[2]) for m in re.finditer(r"class\s+(\w+)[^\n]*:\n(?:(?!\nclass\s)[\s\S])*?__tablename__\s*=\s*['\"]([\w.]+)['\"]", text)]
    for m in re.finditer(r"\bmodel\s+(\w+)\s*\{([^}]*)\}", text):
        if name := re.search(r"@@map\(\s*(?:name\s*:\s*)?\"([\w.]+)\"", m[2]):
            found.append((m[1], name[1]))
    return found


ORM = "path string, entity string, table string"


def liquibase(path: str, text: str) -> list[tuple]:
    """The log of ddl() for a Liquibase changelog in XML or YAML; rollbacks are skipped."""
    if "databaseChangeLog" not in text:
        return []
    sql: list[str] = []

    def table(d: dict) -> str:
        return ".".join(x for x in (d.get("schemaName"), d.get("tableName") or d.get("baseTableName")) if x)

    def change(kind: str, d: dict, columns: list[dict]) -> None:
        def of(c: dict) -> str:
            rules = c.get("constraints") or {}
            yes = lambda k, v: str(rules.get(k)).lower() == v
            return f"{c.get('name')} {c.get('type', '')}{' primary key' if yes('primaryKey', 'true') else ''}{' not null' if yes('nullable', 'false') else ''}{' unique' if yes('unique', 'true') else ''}"

        names = ", ".join(c.get("name", "") for c in columns)
        made = {
            "createTable": lambda: f"create table {table(d)} ({', '.join(map(of, columns))})",
            "addColumn": lambda: f"alter table {table(d)} " + ", ".join(f"add column {of(c)}" for c in columns),
            "dropColumn": lambda: f"alter table {table(d)} drop column {d.get('columnName')}",
            "dropTable": lambda: f"drop table {table(d)}",
            "renameTable": lambda: f"alter table {d.get('oldTableName')} rename to {d.get('newTableName')}",
            "renameColumn": lambda: f"alter table {table(d)} rename column {d.get('oldColumnName')} to {d.get('newColumnName')}",
            "modifyDataType": lambda: f"alter table {table(d)} alter column {d.get('columnName')} type {d.get('newDataType')}",
            "addPrimaryKey": lambda: f"alter table {table(d)} add constraint {d.get('constraintName', 'pk')} primary key ({d.get('columnNames')})",
            "addUniqueConstraint": lambda: f"alter table {table(d)} add constraint {d.get('constraintName', 'uq')} unique ({d.get('columnNames')})",
            "addForeignKeyConstraint": lambda: f"alter table {table(d)} add constraint {d.get('constraintName', 'fk')} foreign key ({d.get('baseColumnNames')}) references {d.get('referencedTableName')}",
            "createIndex": lambda: f"create {'unique ' if str(d.get('unique')).lower() == 'true' else ''}index {d.get('indexName')} on {table(d)} ({names})",
            "sql": lambda: d.get("sql") or d.get("text") or "",
        }.get(kind)
        if made:
            sql.append(made())

    if path.endswith(".xml"):
        import xml.etree.ElementTree as ET

        try:
            root = ET.fromstring(text)
        except ET.ParseError:
            return []
        plain = lambda e: e.tag.rsplit("}", 1)[-1]
        for changes_ in (e for e in root.iter() if plain(e) == "changeSet"):
            for e in changes_:
                columns = [dict(c.attrib) | {"constraints": next((dict(k.attrib) for k in c if plain(k) == "constraints"), None)} for c in e if plain(c) == "column"]
                change(plain(e), dict(e.attrib) | {"text": e.text}, columns)
    else:
        import yaml

        try:
            d = yaml.safe_load(text)
        except yaml.YAMLError:
            return []
        for entry in d.get("databaseChangeLog") or []:
            for step in (entry.get("changeSet") or {}).get("changes") or []:
                for kind, body in step.items():
                    body = body if isinstance(body, dict) else {"text": body}
                    change(kind, body, [c.get("column") or {} for c in body.get("columns") or []])
    return ddl(path, ";\n".join(sql))
