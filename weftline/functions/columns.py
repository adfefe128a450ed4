"""Scalar functions as column expressions: they stay in the JVM, and filters made of them reach the scans."""

from __future__ import annotations

import math
import os
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import words as W


def _of(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- ids and packed edge attributes -------------------------------------------------------------------------------


def stable_id(kind: str, *parts: Column | str) -> Column:
    """64 hex characters for a kind and its key; computable without a look-up."""
    return F.sha2(F.concat_ws(":", F.lit(kind), *[_of(p).cast("string") for p in parts]), 256)


def is_id(x: Column | str) -> Column:
    return _of(x).rlike("^[0-9a-f]{64}$")


def encode_meta(inferred: Column, context: Column, similarity: Column | None = None) -> Column:
    """Bit 0 inferred, bits 1 to 3 context, bits 4 to 7 similarity in fifteenths."""
    meta = inferred.cast("int").bitwiseOR(F.shiftleft(context.cast("int"), 1))
    if similarity is None:
        return meta
    return meta.bitwiseOR(F.shiftleft(F.round(F.least(F.greatest(similarity, F.lit(0.0)), F.lit(1.0)) * 15).cast("int"), 4))


def meta_inferred(meta: Column | str) -> Column:
    return _of(meta).bitwiseAND(1)


def meta_context(meta: Column | str, mask: int = 0b111) -> Column:
    return F.shiftright(_of(meta), 1).bitwiseAND(mask)


def meta_similarity(meta: Column | str) -> Column:
    steps = F.shiftright(_of(meta), 4).bitwiseAND(15)
    return F.when(steps > 0, steps / F.lit(15.0))


def relation_name(code: Column | str) -> Column:
    return F.element_at(F.array(*[F.lit(r) for r in W.RELATIONS]), _of(code).cast("int") + 1)


def context_name(code: Column | str) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in W.CONTEXTS]), _of(code).cast("int") + 1)


# --- questions ----------------------------------------------------------------------------------------------------


def identifier_tokens(text: Column | str) -> Column:
    """Lower-case parts of identifiers; a run of several parts comes first as a whole."""
    runs = F.regexp_extract_all(F.coalesce(_of(text), F.lit("")), F.lit(r"[\p{IsAlphabetic}\p{N}]+"), F.lit(0))
    cut = r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|(?<=\p{IsAlphabetic})(?=\p{N})|(?<=\p{N})(?=\p{IsAlphabetic})"

    def parts(run: Column) -> Column:
        own = F.split(run, cut)
        return F.when(F.size(own) > 1, F.concat(F.array(run), own)).otherwise(own)

    return F.transform(F.flatten(F.transform(runs, parts)), F.lower)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")


def _bare(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, r"^[^\p{IsAlphabetic}\p{N}]+|[^\p{IsAlphabetic}\p{N}]+$", ""))


def _without(text: Column, dropped: Sequence[str], least: int, drop_bare: bool) -> Column:
    own = _words(text)
    out = F.filter(own, lambda w: ~_bare(w).isin(list(dropped)) & ((_bare(w) != "") if drop_bare else F.lit(True)))
    return F.when((F.size(own) < least) | (F.size(out) == 0), text).otherwise(F.array_join(out, " "))


def without_stopwords(text: Column | str) -> Column:
    """The question without stop-words, if it has three words and something is left."""
    return _without(_of(text), W.STOPWORDS, 3, False)


def seed_terms(text: Column | str) -> Column:
    """The question without the words that only make it one; unchanged if nothing is left."""
    return _without(_of(text), W.FILLER, 0, True)


def is_prose(text: Column | str) -> Column:
    """A sentence: a stop-word was dropped, three words are left, and none looks like an identifier."""
    content = _words(without_stopwords(text))
    named = F.exists(content, lambda w: w.rlike(r"[_/\\.:0-9]|\p{Ll}\p{Lu}"))
    return (F.size(content) != F.size(_words(_of(text)))) & (F.size(content) >= 3) & ~named


def weight_override() -> float | None:
    """The weight that WEFTLINE_SUMMARY_WEIGHT sets for all questions, if it is a finite number of 0 or more."""
    try:
        weight = float(os.environ.get("WEFTLINE_SUMMARY_WEIGHT", "").strip())
    except ValueError:
        return None
    return weight if math.isfinite(weight) and weight >= 0 else None


def summary_weight(text: Column | str | None = None) -> Column:
    """The weight of summaries beside texts: 2 for prose, 0 for look-ups, 0.5 without a question; or what is set."""
    own = weight_override()
    if own is not None:
        return F.lit(own)
    return F.lit(0.5) if text is None else F.when(is_prose(text), F.lit(2.0)).otherwise(F.lit(0.0))


def asks_for_dependents(text: Column | str) -> Column:
    low = F.lower(_of(text))
    out = F.lit(False)
    for phrase in W.DEPENDENT_PHRASES:
        out = out | low.contains(phrase)
    return out


def token_estimate(text: Column | str) -> Column:
    """Tokens of a text: characters by 3.5, rounded up."""
    return F.ceil(F.char_length(F.coalesce(_of(text), F.lit(""))) / F.lit(3.5))


# --- markers, paths and types -------------------------------------------------------------------------------------

MARKER = r"(?:REQ|TASK|ADR)-(?:[A-Z][A-Z0-9]*-)*[0-9]+[a-z]?"


def find_markers(text: Column | str) -> Column:
    return F.regexp_extract_all(F.coalesce(_of(text), F.lit("")), F.lit(MARKER), F.lit(0))


def embed_words(text: Column | str) -> Column:
    """One lower-case word for each camel, snake or path part; runs of capitals stay together."""
    spaced = F.regexp_replace(_of(text), r"(?<=[\p{Ll}0-9])(?=\p{Lu})", " ")
    return F.trim(F.lower(F.regexp_replace(spaced, r"[^\p{IsAlphabetic}\p{N}]+", " ")))


def extension(path: Column | str) -> Column:
    """What follows the last point of a file's name, if a point isn't its first character."""
    return F.lower(F.regexp_extract(_of(path), r"[^/.][^/]*\.([^./]+)$", 1))


def is_noise(path: Column | str) -> Column:
    return extension(path).isin(list(W.NOISE_EXTENSIONS)) | F.element_at(F.split(_of(path), "/"), -1).isin(list(W.NOISE_NAMES))


def language(path: Column | str) -> Column:
    out = F.lit(None).cast("string")
    for ext, name in W.LANGUAGES.items():
        out = F.when(extension(path) == ext, name).otherwise(out)
    return out


def file_context(path: Column | str) -> Column:
    """Context code of an edge that begins in a file: 3 in specs, 2 in tests, else 0."""
    p = F.regexp_replace(_of(path), r"\\", "/")
    spec = p.rlike(r"\.(e2e-)?spec\.[^/]*$|/spec/")
    test = p.rlike(r"\.test\.[^/]*$|/(test|tests|__tests__|e2e)/|^tests?/")
    return F.when(spec, 3).when(test, 2).otherwise(0)


def is_eligible(path: Column | str) -> Column:
    """Whether a file is worth a summary: source or Markdown, not sensitive, generated or in a skipped folder."""
    p = _of(path)
    name = F.lower(F.element_at(F.split(p, "/"), -1))
    sensitive = name.rlike(r"^\.env$|^\.env\.|\.(pem|key|p12|pfx)$|^id_(rsa|ed25519|ecdsa|dsa)")
    generated = name.rlike(r"\.min\.js$|\.d\.ts$|\.generated\.|\.pb\.go$|_generated\.go$")
    folders = "|".join(re.escape(f) for f in W.SKIPPED_FOLDERS)
    skipped = p.rlike(rf"^({folders})(/|$)|(^|/)(node_modules|\.git)(/|$)")
    return name.rlike(rf"\.({'|'.join(W.ELIGIBLE_EXTENSIONS)})$") & ~sensitive & ~generated & ~skipped


def normalize_url_path(raw: Column | str) -> Column:
    """A path with parameters as {}, without scheme, host, query, fragment and trailing slash."""
    x = F.trim(_of(raw))
    x = F.when(x.contains("://"), F.regexp_extract(x, r"^.*?://[^/]*(/.*)?$", 1)).otherwise(x)
    x = F.regexp_replace(x, r"^\$\{[^}]*\}(?=/)", "")
    x = F.regexp_replace(x, r"(?s)[?#].*$", "")
    kept = F.filter(F.split(x, "/"), lambda s: s != "")
    return F.concat(F.lit("/"), F.array_join(F.transform(kept, lambda s: F.when(s.rlike(r"^[{:]|^<.*>$|\$\{"), "{}").otherwise(s)), "/"))


def paths_match(client: Column | str, defined: Column | str) -> Column:
    """Equal, or the client's path has only api and version segments more in front."""
    c, d = _of(client), _of(defined)
    prefix = c.substr(F.lit(1), F.length(c) - F.length(d))
    return (c == d) | (c.endswith(d) & prefix.rlike(r"^/*((api|v[0-9]+)/*)+$"))


def normalize_sql_type(sql_type: Column | str) -> Column:
    low = F.regexp_replace(F.regexp_replace(F.lower(F.trim(_of(sql_type))), ", ", ","), r" \(", "(")
    args = F.regexp_extract(low, r"\([^)]*\)?", 0)
    base = F.trim(F.regexp_replace(low, r"\([^)]*\)?", ""))
    names = F.create_map(*[F.lit(x) for pair in W.SQL_TYPES.items() for x in pair])
    return F.concat(F.coalesce(F.try_element_at(names, base), base), args)


def slug(text: Column | str) -> Column:
    """Lower-case letters and digits, with single hyphens between."""
    return F.regexp_replace(F.regexp_replace(F.lower(_of(text)), r"[^\p{IsAlphabetic}\p{N}]+", "-"), "^-+|-+$", "")


# --- secrets ------------------------------------------------------------------------------------------------------

_EDGE = "(?<![A-Za-z0-9_-])", "(?![A-Za-z0-9_-])"
_TOKENS = W.SECRET_TOKENS
_NAMED = "|".join(re.escape(n) for n in W.CREDENTIAL_NAMES)
_REFERENCE = "|".join(re.escape(r) for r in W.CREDENTIAL_REFERENCES)
# A name, what may follow it, and a quoted literal of eight characters or more that is no reference.
_LITERAL = rf"""((?i:{_NAMED})[A-Za-z0-9_"' ]*\s*[=:]\s*)(["'`])(?![^\n"'`]*(?:{_REFERENCE}))(?:(?!\2)[^\n ]){{8,}}?\2"""


def find_secret(text: Column | str) -> Column:
    """The kind of the first secret by kind, or null: a key block, a known token, a literal credential."""
    t = _of(text)
    out = F.when(t.contains("-----BEGIN") & t.contains("PRIVATE KEY-----"), "private key")
    for kind, pattern in _TOKENS.items():
        out = out.when(t.rlike(_EDGE[0] + pattern + _EDGE[1]), kind)
    return out.when(t.rlike(_LITERAL), "hard-coded credential")


def redact_secrets(text: Column | str) -> Column:
    """The text with key blocks, known tokens and literal credentials replaced."""
    t = F.regexp_replace(_of(text), r"(?s)-----BEGIN[^\n]*?PRIVATE KEY-----.*?(?:-----END[^\n]*?-----|$)", "[REDACTED PRIVATE KEY]")
    for pattern in _TOKENS.values():
        t = F.regexp_replace(t, _EDGE[0] + pattern + _EDGE[1], "[REDACTED]")
    return F.regexp_replace(t, _LITERAL, "$1$2[REDACTED]$2")


def snippet(text: Column | str, chars: int) -> Column:
    """The first characters, cut at the last newline if that is past half of their bytes."""
    t = _of(text)
    head = F.substring(t, 1, chars)
    before = F.substring(head, F.lit(1), F.length(head) - F.locate("\n", F.reverse(head)))  # what stands before the last newline
    near = (F.locate("\n", head) > 0) & (F.octet_length(before) > F.floor(F.octet_length(head) / 2))
    return F.when(F.char_length(t) <= chars, t).when(near, before).otherwise(head)


# --- addresses, tags and what a report shows -----------------------------------------------------------------------


def is_specific(path: Column | str) -> Column:
    """Whether an endpoint tells its service: more than one segment besides parameters, or one that isn't generic."""
    own = F.filter(F.split(_of(path), "/"), lambda s: (s != "") & (s != "{}"))
    return (F.size(own) > 1) | ((F.size(own) == 1) & ~F.get(own, F.lit(0)).isin(list(W.GENERIC_SEGMENTS)))


def wiki_slug(text: Column | str) -> Column:
    """A page's name: ASCII letters and digits in lower case with single hyphens, at most 40 characters."""
    own = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(_of(text), "[^A-Za-z0-9]+", "-")), "^-+|-+$", ""), "^$", "community")
    return F.substring(own, 1, 40)


def valid_tag(tag: Column | str) -> Column:
    """A repository's tag: up to 64 letters, digits, points, underscores and hyphens."""
    return _of(tag).rlike(r"^[A-Za-z0-9._-]{1,64}$")


def default_tag(source: Column | str) -> Column:
    """The last part of a place, without its extension, with hyphens for what a tag can't hold."""
    last = F.element_at(F.split(F.regexp_replace(_of(source), "/+$", ""), "/"), -1)
    return F.regexp_replace(F.regexp_replace(last, r"(?<=.)\.[^.]*$", ""), "[^A-Za-z0-9._-]", "-")


def format_bytes(n: Column | str) -> Column:
    b = _of(n)
    return (
        F.when(b >= 1024 * 1024, F.format_string("%.1f MB", F.bround(b / F.lit(1048576.0), 1)))
        .when(b >= 1024, F.format_string("%.1f KB", F.bround(b / F.lit(1024.0), 1)))
        .otherwise(F.format_string("%d B", b))
    )


def format_day(seconds: Column | str) -> Column:
    """YYYY-MM-DD of seconds since 1970, in UTC whatever the session's zone."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(_of(seconds) / 86_400).cast("int")), "yyyy-MM-dd")


def redact_dsn(message: Column | str, dsn: Column | str) -> Column:
    """A message without the passwords of a connection string: user:password@ of an address, or password= of a list."""
    address = F.regexp_extract(_of(dsn), r"^[^:]*?://([^@]*)@", 1)
    first = F.regexp_extract(address, r"^[^:]*:(.*)$", 1)
    listed = F.transform(F.regexp_extract_all(_of(dsn), F.lit(r"(?:^|\s)password=(\S+)"), F.lit(1)), lambda p: F.regexp_replace(p, "^'+|'+$", ""))
    secrets = F.filter(F.concat(F.array(first), listed), lambda p: p != "")
    return F.aggregate(secrets, _of(message).cast("string"), lambda text, p: F.replace(text, p, F.lit("[redacted]")))


def embedding_text(nodes_kind: Column | str = "kind") -> Column:
    """What is embedded of a node (kind, label, path, name, title, body, state): null for kinds that aren't."""
    kind, title, words = _of(nodes_kind), F.coalesce(F.col("title"), F.lit("")), embed_words("name")
    return (
        F.when(kind.isin("requirement", "task", "adr"), F.concat(title, F.lit(". "), F.substring(F.coalesce("body", F.lit("")), 1, 600)))
        .when(kind == "doc_section", title)
        .when((kind == "symbol") & F.col("path").isNotNull(), F.concat(words, F.lit(" in "), embed_words("path")))
        .when(kind == "symbol", words)
        .when(kind.isin("table", "view"), F.concat(kind, F.lit(" "), words))
        .when((kind == "annotation") & (F.col("state") == "fresh"), F.concat(F.col("label"), F.lit(". "), F.coalesce("body", F.lit(""))))
    )
