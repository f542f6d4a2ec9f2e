"""Paths, object names, references, connection strings and other small text forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_path(path: Column) -> Column:
    """Forward slashes, none at the end, upper-cased: equal for paths that name the same file."""
    return F.upper(F.rtrim(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("/")))


def relative_path(path: Column, root: Column) -> Column:
    """The path below root (whatever its case), the whole path where it lies elsewhere."""
    p, r = F.replace(path, F.lit("\\"), F.lit("/")), F.concat(F.rtrim(F.replace(root, F.lit("\\"), F.lit("/")), F.lit("/")), F.lit("/"))
    return F.when(F.startswith(F.lower(p), F.lower(r)), F.substring(p, F.length(r) + 1, F.length(p))).otherwise(p)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def extension(path: Column) -> Column:
    """Lower-cased, with its point; empty if the file name has none."""
    return F.lower(F.regexp_extract(file_name(path), r"(\.[^.]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def object_name(name: Column) -> Column:
    """Lower-cased, without brackets at its ends."""
    return F.lower(F.regexp_replace(name, r"^[\[\]]+|[\[\]]+$", ""))


def split_object_name(name: Column, default: str = "dbo") -> Column:
    """struct(space, name) of a dotted, perhaps bracketed name; without a space part, the default."""
    parts = F.filter(F.transform(F.split(F.regexp_replace(name, r"[\[\]]", ""), r"\."), lambda x: F.trim(x)), lambda x: x != "")
    return F.struct(F.when(F.size(parts) > 1, F.try_element_at(parts, F.lit(-2))).otherwise(F.lit(default)).alias("space"), F.try_element_at(parts, F.lit(-1)).alias("name"))


def normalize_reference(value: Column) -> Column:
    """A link or script path without query, fragment, quotes, host, tilde or slash in front."""
    v = F.regexp_replace(F.trim(F.replace(value, F.lit("\\"), F.lit("/"))), r"[?#].*$", "")
    v = F.regexp_replace(F.trim(v), r"""^["']+|["']+$""", "")
    return F.regexp_replace(F.regexp_replace(v, r"(?i)^https?://[^/]+", ""), r"^[~/]+", "")


def html_decode(text: Column) -> Column:
    """The five named characters and the apostrophe's number; the ampersand last, so that nothing is decoded twice."""
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("apos", "'"), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return text


# fixed value: an attribute of a tag
ATTRIBUTE = r'([A-Za-z_:][A-Za-z0-9_.:-]*)\s*=\s*"([^"]*)"'


def tag_attributes(tag: Column) -> Column:
    """The attributes of a tag as a map, names lower-cased, values decoded; the first of a name counts."""
    pairs = F.transform(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(0)), lambda a: F.struct(F.lower(F.regexp_extract(a, ATTRIBUTE, 1)).alias("key"), html_decode(F.regexp_extract(a, ATTRIBUTE, 2)).alias("value")))
    return F.map_from_entries(F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, 1, i), lambda o: o["key"] == p["key"])))


def connection_part(connection: Column, key: str) -> Column:
    """The value of a key in a connection string; null if it isn't there."""
    pattern = rf"(?i)(?:^|;)\s*{key}\s*=\s*([^;]*)"
    return F.when(connection.rlike(pattern), F.trim(F.regexp_extract(connection, pattern, 1)))


def plugin_target(encoded: Column) -> Column:
    """struct(decoded, assembly, class_name) of a base64 text, cut at its first slash; what can't be decoded is empty."""
    text = F.coalesce(F.try_validate_utf8(F.decode(F.try_to_binary(encoded, F.lit("base64")), "UTF-8")), F.lit(""))
    at = F.instr(text, "/")
    return F.struct(text.alias("decoded"), F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text).alias("assembly"), F.when(at > 0, F.substring(text, at + 1, F.length(text))).otherwise(F.lit("")).alias("class_name"))


def shortened(text: Column, most: int) -> Column:
    """At most `most` characters, and an ellipsis where some are cut off."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("…"))).otherwise(text)


def single_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\r\n]+", " "))


def quoted_literal(text: Column) -> Column:
    """Backslashes and single quotes escaped, for a literal in a query text."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))


# fixed values: words of a name that holds a secret, and what takes a secret's place
SECRET_NAMES = ("key", "token", "secret", "password", "credential")
SECRET_MARK = "REPLACE_WITH_YOUR_API_KEY"


def mask_secrets(settings: Column) -> Column:
    """A map of settings in which values behind names that speak of a secret are masked; null values stay."""
    named = lambda k: F.lower(k).rlike("|".join(SECRET_NAMES))
    return F.transform_values(settings, lambda k, v: F.when(named(k) & v.isNotNull(), F.lit(SECRET_MARK)).otherwise(v))


def third_party(path: Column) -> Column:
    """Whether a script is a library's rather than the project's own: minified, or below a vendor folder."""
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    return low.rlike(r"(^|/)(node_modules|bower_components|vendor|packages|lib|libs)/") | low.rlike(r"\.min\.(js|css)$")


def asset_kind(path: Column) -> Column:
    """page, bundle, script, source, config or null by the file's name."""
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    return (
        F.when(low.rlike(r"\.bundle\.js$|/dist/|\.min\.js$"), "bundle")
        .when(low.rlike(r"\.(aspx|ascx|master|cshtml|html)$"), "page")
        .when(low.rlike(r"(^|/)(webpack|vite|rollup|gulpfile)[^/]*\.(js|ts)$|(^|/)package\.json$"), "config")
        .when(low.rlike(r"\.(js|jsx|ts|tsx)$"), "script")
        .when(low.rlike(r"\.cs$"), "source")
    )


# fixed value: addresses that an endpoint may have
ENDPOINT = r"(?i)^(?:/|~/|https?://)|(?:/|\\)(?:api|ajax|service|controller|data)(?:/|\\)|/(?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+$"


def looks_like_endpoint(text: Column) -> Column:
    return text.rlike(ENDPOINT)
