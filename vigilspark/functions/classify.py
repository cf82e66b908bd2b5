"""File classification, binary and language signs, bounded text, score bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilspark.functions.tables import LANGUAGE_OF, WEB_SOURCE, literal_map

READ_LIMIT = 32 << 20
BINARY_PREFIX = 8000

# Signs of a language in content; a file may show several.
# Java regex: (?d) keeps `.` and `$` to line feeds only, and white space is spelt out without the vertical tab.
SIGNS: dict[str, str] = {
    "php": r"(?di)<\?(?:php|=|[\t\n\f\r ]|\z)|<\?[0-9A-Za-z_]",
    "jsp": r"(?dis)<%[=!@]?|<jsp:|javax\.servlet|java\.lang\.|page[\t\n\f\r ]+import[\t\n\f\r ]*=",
    "asp": r"(?dis)<%@|<script[^>]*runat[\t\n\f\r ]*=|\brequest[\t\n\f\r ]*[.(\[]|server\.createobject",
    "perl": r"(?dm)^#!.*\bperl\b|\buse[\t\n\f\r ]+(?:strict|warnings|CGI)\b|\bmy[\t\n\f\r ]+[$@%][0-9A-Za-z_]",
    "python": r"(?dm)^#!.*\bpython[0-9.]*\b|^[\t\n\f\r ]*(?:import|from)[\t\n\f\r ]+[0-9A-Za-z_]|^[\t\n\f\r ]*def[\t\n\f\r ]+[0-9A-Za-z_]+[\t\n\f\r ]*\(",
    "shtml": r"(?di)<!--[\t\n\f\r ]*#[\t\n\f\r ]*(?:exec|include|echo|config|printenv)",
}
#: Languages whose sign is another one's: either ASP flavour shows the same directives, and CGI is Perl or Python.
DERIVED_SIGNS = {"aspx": ("asp",), "cgi": ("perl", "python")}
STRONG_MARKER = (
    r"(?di)<\?php|<%@[\t\n\f\r ]*(?:page|control|webhandler|master|servicehost|import)|<jsp:|javax\.servlet"
    r"|#![\t\n\f\r ]*/[^\t\n\f\r ]*(?:perl|python)|<script[^>]{0,60}runat[\t\n\f\r ]*=|server\.createobject|executeglobal|<!--[\t\n\f\r ]*#[\t\n\f\r ]*exec"
)


def basename(path: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(path, "/+$", ""), "[^/]*$", 0)


def language(path: Column) -> Column:
    """Language by name: suffixes from right to left; the last may be of any language, inner ones only web source.
    Leading dots are no suffix, and neither is what comes before the first dot."""
    base = F.regexp_replace(F.lower(basename(path)), r"^\.+", "")
    suffixes = F.reverse(F.slice(F.split(base, r"\."), 2, 1 << 20))
    table = literal_map(LANGUAGE_OF)
    named = F.transform(suffixes, lambda s, i: F.when((i == 0) | F.element_at(table, s).isin(*WEB_SOURCE), F.element_at(table, s)))
    return F.coalesce(F.get(F.array_compact(named), 0), F.lit("unknown"))


def canonical_extension(path: Column) -> Column:
    """The last suffix with its dot, lower-cased; empty without one."""
    base = F.regexp_replace(F.lower(basename(path)), r"^\.+", "")
    return F.when(F.instr(base, ".") > 0, F.concat(F.lit("."), F.substring_index(base, ".", -1))).otherwise("")


def looks_binary(content: Column) -> Column:
    """A NUL among the first bytes; content is binary or text."""
    return F.contains(F.substring(content.cast("binary"), 1, BINARY_PREFIX), F.lit(b"\x00"))


def signs(text: Column, binary: Column) -> Column:
    """Languages whose sign the content shows, in a fixed order; binary content needs a strong marker."""
    shown = {lang: text.rlike(pattern) for lang, pattern in SIGNS.items()}
    for lang, sources in DERIVED_SIGNS.items():
        shown[lang] = shown[sources[0]] if len(sources) == 1 else shown[sources[0]] | shown[sources[1]]
    found = F.array_compact(F.array(*(F.when(shown[lang], F.lit(lang)) for lang in WEB_SOURCE)))
    return F.when(binary & ~text.rlike(STRONG_MARKER), F.array().cast("array<string>")).otherwise(found)


#: Reads of the variables that a web server hands to a CGI program (fixed values).
CGI_VARIABLE = (
    r"(?:\$ENV[\t\n\f\r ]*\{[\t\n\f\r ]*['\"]?|environ[\t\n\f\r ]*[\[(][\t\n\f\r ]*['\"])(?:QUERY_STRING|REQUEST_METHOD|CONTENT_LENGTH|CONTENT_TYPE|PATH_INFO|PATH_TRANSLATED"
    r"|REMOTE_ADDR|REMOTE_HOST|REMOTE_IDENT|REMOTE_USER|AUTH_TYPE|SCRIPT_NAME|GATEWAY_INTERFACE|HTTP_[A-Z0-9_]+)"
)


def dialect(path: Column, text: Column) -> Column:
    """Perl or Python for files of the scripting pass, null for others: by language; CGI by its shebang, else Perl; a name
    without extension by its shebang, if it reads a CGI variable."""
    lang = language(path)
    first = F.lower(F.regexp_extract(F.substring(text, 1, 256), r"\A#!([^\r\n]*)", 1))
    shebang = F.when(F.contains(first, F.lit("python")), "python").when(F.contains(first, F.lit("perl")), "perl")
    bare = ~F.contains(basename(path), F.lit("."))
    return F.when(lang.isin("perl", "python"), lang).when(lang == "cgi", F.coalesce(shebang, F.lit("perl"))).when((lang == "unknown") & bare & text.rlike(CGI_VARIABLE), shebang)


def shows(text: Column, languages: tuple[str, ...]) -> Column:
    """Whether text content shows the sign of one of the languages, by the order of `signs`."""
    found = F.lit(False)
    for lang in languages:
        for source in DERIVED_SIGNS.get(lang, (lang,)):
            found = found | text.rlike(SIGNS[source])
    binary = F.contains(F.substring(text, 1, BINARY_PREFIX), F.lit("\x00"))
    return found & (~binary | text.rlike(STRONG_MARKER))


def admits(path: Column, text: Column, languages: tuple[str, ...]) -> Column:
    """Whether a pass for the languages examines a file: its name says one of them, or says nothing and the content shows one."""
    lang = language(path)
    return lang.isin(*languages) | ((lang == "unknown") & shows(text, languages))


def pass_dialect(path: Column, text: Column) -> Column:
    """Perl or Python for files that the CGI pass examines: also a name that says nothing over a text that shows the sign, by
    its shebang, else Perl."""
    lang = language(path)
    first = F.lower(F.regexp_extract(F.substring(text, 1, 256), r"\A#!([^\r\n]*)", 1))
    python = F.contains(first, F.lit("python"))
    shown = (lang == "unknown") & shows(text, ("cgi",))
    return F.coalesce(dialect(path, text), F.when(shown, F.when(python, "python").otherwise("perl")))


def tier_of_score(score: Column) -> Column:
    return F.when(score >= 85, "confirmed").when(score >= 60, "likely-malicious").when(score >= 40, "suspicious").otherwise("clean")


def at_least(score: Column, floor: int) -> Column:
    return F.greatest(score, F.lit(floor))


def printable(text: Column, most_bytes: int | None = None) -> Column:
    """Control characters as question marks; cut to so many UTF-8 bytes without splitting a character."""
    clean = F.regexp_replace(text, r"[\x00-\x1F\x7F]", "?")
    if most_bytes is None:
        return clean
    cut = F.substring(clean.cast("binary"), 1, most_bytes)
    whole = F.regexp_replace(F.hex(cut), "(?:[CD][0-9A-F]|E[0-9A-F](?:[89AB][0-9A-F])?|F[0-7](?:[89AB][0-9A-F]){0,2})$", "")
    return F.when(F.octet_length(clean) <= most_bytes, clean).otherwise(F.decode(F.unhex(whole), "UTF-8"))


def bounded_list(values: Column, most: int) -> Column:
    """Sorted distinct values joined by commas, at most `most` of them, then how many more."""
    sorted_ = F.array_sort(F.array_distinct(values))
    more = F.size(sorted_) - most
    return F.concat(F.array_join(F.slice(sorted_, 1, most), ", "), F.when(more > 0, F.format_string(" (+%d more)", more)).otherwise(""))


def windows_basename(path: Column) -> Column:
    return F.regexp_extract(F.lower(F.trim(path)), r"[^\\/]*$", 0)


def within(path: Column, root: Column) -> Column:
    """Path containment by segments, not by string prefix."""
    top = F.regexp_replace(root, "/+$", "")
    return (path == top) | (path == root) | F.startswith(path, F.concat(top, F.lit("/")))
