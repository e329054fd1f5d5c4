"""URLs as Column expressions: parse, resolve against a base, normal form, host. Everything stays in the JVM.

Resolution follows RFC 3986, section 5.2; the normal form is that of the web's URLs (lower-case scheme and host, no default
port, a path that isn't empty, characters that a URL can't hold as percent codes). What is no http(s) URL is null, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from folioforge.functions.text import bound

#: Scheme, authority, path, query and fragment, as in RFC 3986, appendix B; marks included for what may be absent.
PARTS = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"
NAMES = ("scheme", "authority", "path", "query", "fragment")

#: User, host and port of an authority.
AUTHORITY = r"^//(?:([^@]*)@)?(\[[0-9A-Fa-f:.]+\]|[^\x00-\x20#/:<>?@\[\\\]^|%\x7F]+)(?::([0-9]*))?$"

#: The ports that go without saying.
DEFAULT_PORTS = {"http:": "80", "https:": "443"}


def parsed(url: Column) -> Column:
    """``struct(scheme, authority, path, query, fragment)``, each with its mark (``http:``, ``//host``, ``?q``, ``#f``), '' if absent."""
    return F.struct(*[F.regexp_extract(url, PARTS, i + 1).alias(n) for i, n in enumerate(NAMES)])


def without_dots(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments, which take the segment before them; a slash at its end stays or comes where one of them
    was last. A relative path's ``..`` beyond its start goes too."""
    segments = F.split(path, "/", -1)
    last = F.element_at(segments, -1)
    start = F.array().cast("array<string>")
    up = lambda done: F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
    kept = F.aggregate(segments, start, lambda done, s: F.when(s == ".", done).when(s == "..", F.when(F.size(done) <= F.when(F.startswith(path, F.lit("/")), 1).otherwise(0), done).otherwise(up(done))).otherwise(F.concat(done, F.array(s))))
    whole = F.array_join(kept, "/")
    return F.when(last.isin(".", ".."), F.when(F.endswith(whole, F.lit("/")), whole).otherwise(F.concat(whole, F.lit("/")))).otherwise(whole)


def merged(base: Column, path: Column) -> Column:
    """A relative path in place of what follows the last slash of the base's path."""
    kept = F.when((base["path"] == "") & (base["authority"] != ""), F.lit("/")).otherwise(F.regexp_extract(base["path"], r"(?s)^(.*/)?", 0))
    return F.concat(kept, path)


def resolved(reference: Column, base: Column) -> Column:
    """A reference against a base, by RFC 3986 section 5.2.2; null if either is. The result is not checked."""

    def of(r: Column, b: Column) -> Column:
        own = (r["scheme"] != "") | (r["authority"] != "")
        absolute = F.startswith(r["path"], F.lit("/"))
        path = F.when(own | absolute, without_dots(r["path"])).when(r["path"] == "", b["path"]).otherwise(without_dots(merged(b, r["path"])))
        query = F.when(~own & (r["path"] == "") & (r["query"] == ""), b["query"]).otherwise(r["query"])
        return F.concat(F.when(r["scheme"] != "", r["scheme"]).otherwise(b["scheme"]), F.when(own, r["authority"]).otherwise(b["authority"]), path, query, r["fragment"])

    found = bound(parsed(reference), lambda r: bound(parsed(base), lambda b: of(r, b)))
    return F.when(reference.isNotNull() & base.isNotNull(), found)


def _coded(text: Column, plain: str) -> Column:
    """Everything but the characters ``plain`` (a regex class) as percent codes of its UTF-8."""
    runs = F.regexp_extract_all(text, F.lit(f"[{plain}]+|[^{plain}]+"), F.lit(0))
    code = lambda s: F.regexp_replace(F.hex(F.encode(s, "UTF-8")), "(..)", "%$1")
    return F.when(text.rlike(f"[^{plain}]"), F.array_join(F.transform(runs, lambda s: F.when(s.rlike(f"^[{plain}]"), s).otherwise(code(s))), "")).otherwise(text)


def normal(url: Column) -> Column:
    """The normal form of an absolute http(s) URL; null for anything else: another scheme, no host, a host with characters that none has,
    a port above 65535."""

    def of(u: Column) -> Column:
        scheme = F.lower(u["scheme"])
        user, host, port = (F.regexp_extract(u["authority"], AUTHORITY, i) for i in (1, 2, 3))
        number = F.regexp_replace(port, "^0+(?=[0-9])", "")
        default = F.lit(False)
        for name, value in DEFAULT_PORTS.items():
            default = default | ((scheme == name) & (number == value))
        shown = F.when((number == "") | default, F.lit("")).otherwise(F.concat(F.lit(":"), number))
        good = scheme.isin(*DEFAULT_PORTS) & (host != "") & (F.coalesce(number.try_cast("int"), F.when(number == "", F.lit(0)), F.lit(1 << 20)) <= 65535)
        text = F.concat(
            scheme, F.lit("//"), F.when(user == "", F.lit("")).otherwise(F.concat(user, F.lit("@"))), F.lower(host), shown,
            F.when(F.startswith(u["path"], F.lit("/")), F.lit("")).otherwise(F.lit("/")), _coded(u["path"], r"\x21\x23-\x3B\x3D\x40-\x5F\x61-\x7A\x7C\x7E"),
            _coded(u["query"], r"\x21\x23-\x26\x28-\x3B\x3D\x3F-\x7E"), _coded(u["fragment"], r"\x21\x23-\x3B\x3D\x3F-\x5F\x61-\x7E"),
        )
        return F.when(good, text)

    return bound(parsed(url), of)


def link_target(href: Column, base: Column) -> Column:
    """The page that a link of a page at ``base`` leads to, in normal form; null if it leads to none. White space around it and line feeds
    and tabs inside it don't count; a backslash in front of the query is a slash."""
    bare = F.regexp_replace(F.regexp_replace(href, "[\\t\\n\\r]", ""), "^[\\x00-\\x20]+|[\\x00-\\x20]+$", "")
    head = F.regexp_extract(bare, r"^[^?#]*", 0)
    own = F.coalesce(F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1)), F.lit(""))
    web = own.isin("", *DEFAULT_PORTS)
    slashed = F.when(web, F.concat(F.translate(head, "\\", "/"), F.substring(bare, F.length(head) + 1, F.length(bare)))).otherwise(bare)
    return F.when(web, normal(resolved(slashed, base)))


def host(url: Column) -> Column:
    """Host and port of a URL in normal form; null if it is none."""
    return F.nullif(F.regexp_extract(url, r"^https?://(?:[^/?#@]*@)?([^/?#]+)", 1), F.lit(""))
