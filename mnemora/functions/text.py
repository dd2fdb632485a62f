"""Text projections: normalisation, identity, breadcrumbs, keys, names.

Column functions stay in the JVM. Only NFKC, which Spark has no function for, is
an Arrow UDF, and only ``normalize_text`` and ``normalize_query`` use it.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The folding of typographic characters.
FOLD_ONE = {
    "‘": "'", "’": "'", "‚": "'", "‛": "'",
    "“": '"', "”": '"', "„": '"', "‟": '"',
    "–": "-", " ": " ", " ": " ", " ": " ",
}
FOLD_MANY = {"—": " - ", "―": " - ", "…": "..."}
FOLD_NONE = "​‌‍﻿­"
# Prefixes that look like ticket keys and are none.
TICKET_STOPLIST = (
    "UTF", "ISO", "RFC", "SHA", "MD", "AES", "RSA", "EC", "TLS", "SSL", "HTTP",
    "CVE", "GPT", "IPV", "OAUTH", "BASE", "X", "S", "EN", "A", "I18N", "L10N",
)
TICKET_PATTERN = r"\b([A-Z][A-Z0-9]{1,9}-\d{1,6})\b"
MAX_TICKETS = 20
REPO_SOURCE_TYPES = ("git", "github", "gitlab", "azure_devops", "files")
# Name parts too generic to identify anything.
GENERIC_TOKENS = (
    "com", "org", "net", "io", "www", "github", "gitlab", "bitbucket",
    "core", "common", "api", "app", "apps", "web", "ui", "client", "server",
    "service", "services", "lib", "libs", "src", "main", "test", "tests",
    "tools", "utils", "shared", "models", "model", "docs", "data", "base",
)


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def nfkc(text: Column) -> Column:
    """NFKC of a text (null: empty); only texts with other than ASCII characters leave the JVM."""
    said = F.coalesce(text, F.lit(""))
    return F.coalesce(_nfkc(F.when(said.rlike(r"[^\x00-\x7f]"), said)), said)


def fold(text: Column) -> Column:
    """Typographic characters to their ASCII spelling; zero-width ones go."""
    out = F.translate(text, "".join(FOLD_ONE) + FOLD_NONE, "".join(FOLD_ONE.values()))
    for a, b in FOLD_MANY.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def normalize_text(text: Column) -> Column:
    """Body text: NFKC, folding, \\n line ends, no control characters, single blanks, no trailing blanks, at most one empty line; null is empty."""
    out = fold(nfkc(text))
    out = F.regexp_replace(out, r"\r\n?", "\n")
    out = F.regexp_replace(out, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    out = F.regexp_replace(out, r"[ \t]+", " ")
    out = F.regexp_replace(out, r"[ \t]+(\n|$)", "$1")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def normalize_query(text: Column) -> Column:
    return F.trim(F.regexp_replace(fold(nfkc(text)), r"\s+", " "))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def doc_id(source_id: Column, uri: Column) -> Column:
    return F.substring(F.sha2(F.concat(source_id, F.lit("|"), uri), 256), 1, 24)


def breadcrumb(source_id: Column, title: Column, uri: Column) -> Column:
    """source · title · uri, each once, the uri cut to 120 characters after it is compared."""
    t, u = F.trim(F.coalesce(title, F.lit(""))), F.trim(F.coalesce(uri, F.lit("")))
    parts = F.array(
        source_id,
        F.when((t != "") & (t != source_id), t),
        F.when((u != "") & (u != t) & (u != source_id), F.substring(u, 1, 120)),
    )
    return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), " · ")


def with_context(crumb: Column, chunk: Column) -> Column:
    return F.concat(F.lit("["), crumb, F.lit("]\n"), chunk)


def without_context(crumb: Column, chunk: Column) -> Column:
    head = F.concat(F.lit("["), crumb, F.lit("]\n"))
    return F.when(F.startswith(chunk, head), F.substr(chunk, F.length(head) + 1)).otherwise(chunk)


def ticket_keys(text: Column) -> Column:
    """Distinct ticket keys in reading order, at most MAX_TICKETS."""
    found = F.regexp_extract_all(text, F.lit(TICKET_PATTERN), F.lit(1))
    real = F.filter(found, lambda k: ~F.substring_index(k, "-", 1).isin(*TICKET_STOPLIST))
    return F.slice(F.array_distinct(real), 1, MAX_TICKETS)


def source_entity(source_id: Column) -> Column:
    """struct(id, name, type) of the entity a source stands for."""
    colon = F.instr(source_id, ":")
    typed = (colon > 0) & (colon < F.length(source_id))
    name = F.when(typed, F.substr(source_id, colon + 1)).otherwise(source_id)
    kind = F.when(typed & F.substring_index(source_id, ":", 1).isin(*REPO_SOURCE_TYPES), "repo").otherwise("source")
    return F.struct(F.concat(kind, F.lit(":"), F.lower(name)).alias("id"), name.alias("name"), kind.alias("type"))


def aliases(identifier: Column, drop_prefix: bool = True) -> Column:
    """Spoken forms of a dotted or hyphenated identifier."""
    parts = F.filter(F.split(F.lower(identifier), r"[.\-_]"), lambda x: x != "")
    rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    forms = F.array(F.array_join(rest, " "), F.array_join(rest, "."), F.array_join(parts, " ")) if drop_prefix else F.array(F.array_join(parts, " "))
    kept = F.array_distinct(F.filter(forms, lambda f: (f != "") & (f != F.lower(identifier))))
    return F.when(F.size(parts) < 2, F.array().cast("array<string>")).otherwise(kept)


def spoken_base(identifier: Column) -> Column:
    """The part of an identifier that people say: no scope, module path or group."""
    return F.substring_index(F.substring_index(F.ltrim(identifier, F.lit("@")), "/", -1), ":", -1)


def spoken_forms(identifier: Column) -> Column:
    """Spoken forms of a package's or repository's name; a dotted one is also said without its first part."""
    base = spoken_base(identifier)
    return F.when(F.contains(base, F.lit(".")), aliases(base)).otherwise(aliases(base, drop_prefix=False))


def name_parts(identifier: Column) -> Column:
    return F.filter(F.split(F.lower(spoken_base(identifier)), r"[.\-_]"), lambda x: x != "")


def name_tokens(identifier: Column) -> Column:
    """The parts of an identifier that are not generic."""
    return F.array_distinct(F.filter(F.split(F.lower(identifier), r"[^a-z0-9]+"), lambda x: (x != "") & ~x.isin(*GENERIC_TOKENS)))


def alias_allowed(identifier: Column, org_tokens: Column) -> Column:
    """Whether a dependency looks like one of the organisation's own: it shares a telling part, or has three parts."""
    parts = F.filter(F.split(F.lower(identifier), r"[.\-_]"), lambda x: x != "")
    return F.arrays_overlap(name_tokens(identifier), org_tokens) | (F.size(parts) >= 3)


def normalize_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", "")


def all_generic(name: Column) -> Column:
    parts = F.filter(F.split(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+"), lambda x: x != "")
    return (F.size(parts) > 0) & F.forall(parts, lambda x: x.isin(*GENERIC_TOKENS))


def tokens(text: Column) -> Column:
    """Lower-case search tokens in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0))


def match_terms(query: Column, most: int = 32) -> Column:
    """The first `most` tokens of a query, each once: terms that are OR-ed."""
    return F.array_distinct(F.slice(tokens(query), 1, most))


def source_label(source_id: Column) -> Column:
    colon = F.instr(source_id, ":")
    return F.when((colon > 0) & (colon < F.length(source_id)), F.substr(source_id, colon + 1)).otherwise(source_id)


def fold_member(name: Column) -> Column:
    """Last path segment, trimmed, lower case."""
    return F.lower(F.trim(F.element_at(F.split(F.trim(F.coalesce(name, F.lit(""))), r"[\\/]"), -1)))


def sharing_token(url: Column) -> Column:
    """u! and the unpadded base64url of a sharing link."""
    return F.concat(F.lit("u!"), F.rtrim(F.translate(F.base64(F.encode(url, "UTF-8")), "+/", "-_"), F.lit("=")))


def strip_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"\s+", " "))


def label_applies(uri: Column, prefix: Column) -> Column:
    """A label's prefix covers a uri; no character of it is a wildcard."""
    return F.startswith(F.coalesce(uri, F.lit("")), prefix)


def clamp(value: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def archive_members(text: Column) -> Column:
    """Member names of an expanded archive's stored text."""
    return F.regexp_extract_all(text, F.lit("(?m)^--- (.+) ---$"), F.lit(1))


def upload_name(name: Column) -> Column:
    """A file name that is safe to store: no folders, few marks, never empty."""
    base = F.regexp_replace(F.substring_index(F.replace(name, F.lit("\\"), F.lit("/")), "/", -1), r"[^A-Za-z0-9._ +()\-]", "_")
    kept = F.regexp_replace(base, r"^[ .]+|[ .]+$", "")
    return F.substring(F.when(kept == "", "upload").otherwise(kept), 1, 180)


def distinct_upload_name(name: Column, digest: Column) -> Column:
    """The name of a file that differs from the stored one of the same name: part of its content's hash before the extension."""
    safe, short = upload_name(name), F.substring(digest, 1, 8)
    dotted = F.concat(F.regexp_extract(safe, r"^(.*)\.[^.]*$", 1), F.lit("-"), short, F.lit("."), F.substring_index(safe, ".", -1))
    return F.when(F.contains(safe, F.lit(".")), dotted).otherwise(F.concat(safe, F.lit("-"), short))


def note_uri(topic: Column, fact: Column) -> Column:
    """Address of a taught fact: a slug of its topic or beginning, and a hash of both, so that teaching it again changes nothing."""
    slug = F.trim(F.regexp_replace(F.lower(F.coalesce(F.nullif(topic, F.lit("")), F.substring(fact, 1, 40))), "[^a-z0-9]+", "-"), F.lit("-"))
    digest = F.sha2(F.concat(F.coalesce(topic, F.lit("")), F.lit("\n"), fact), 256)
    return F.concat(F.lit("note://"), F.when(slug == "", "note").otherwise(slug), F.lit("-"), F.substring(digest, 1, 10))


def query_hash(query: Column) -> Column:
    """Hash of a question without regard to case and blanks."""
    return F.sha2(F.trim(F.regexp_replace(F.lower(F.coalesce(query, F.lit(""))), r"\s+", " ")), 256)


def token_hash(token: Column) -> Column:
    """What is stored of an access token."""
    return F.sha2(token, 256)
