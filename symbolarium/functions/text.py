"""Text, line and markup functions, all ``Column -> Column`` over built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(query: Column) -> Column:
    """Lower-cased, split at Unicode white space, empties dropped."""
    return F.filter(F.split(F.lower(query), r"(?U)\s+"), lambda t: t != "")


def is_subsequence(needle: Column, hay: Column) -> Column:
    """Whether the characters of ``needle`` occur in ``hay`` in order, gaps allowed.

    A needle that is a literal becomes one quoted pattern, ``is_subsequence_of``; this fold
    over the haystack is for needles that are columns.
    """
    matched = F.aggregate(
        F.split(hay, ""), F.lit(0),
        lambda at, ch: F.when((at < F.length(needle)) & (F.substring(needle, at + 1, F.lit(1)) == ch), at + 1).otherwise(at),
    )
    return matched >= F.length(needle)


def is_subsequence_of(needle: str, hay: Column) -> Column:
    """The same for a literal needle: its characters quoted, anything between them."""
    return hay.rlike("(?s)" + ".*?".join(f"\\x{{{ord(c):X}}}" for c in needle)) if needle else F.lit(True)


def collapse_spaces(text: Column) -> Column:
    """White-space runs to one space, ends trimmed (signatures)."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip_tags(html: Column) -> Column:
    """``<...>`` runs removed; an unterminated one eats to the end."""
    return F.regexp_replace(html, r"(?s)<[^>]*(>|$)", "")


#: The entities that are decoded, the ampersand last.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def decode_entities(html: Column) -> Column:
    """The five basic entities, in one pass: with ``&amp;`` last nothing decodes twice."""
    for entity, char in ENTITIES:
        html = F.replace(html, F.lit(entity), F.lit(char))
    return html


def split_signature(text: Column) -> Column:
    """``name :: type`` at the first `` :: ``, both trimmed; no separator: empty type."""
    at = F.instr(text, " :: ")
    return F.struct(
        F.trim(F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text)).alias("name"),
        F.trim(F.when(at > 0, F.substring(text, at + 4, F.length(text))).otherwise("")).alias("signature"),
    )


def lines(text: Column) -> Column:
    """Lines; a trailing newline adds none."""
    return F.split(F.regexp_replace(text, r"\n\z", ""), "\n")


def clamped_slice(rows: Column, first: Column, last: Column) -> Column:
    """Lines ``first`` to ``last``, 1-based, both pulled into the text's range."""
    n = F.size(rows)
    lo = F.greatest(F.lit(1), F.least(first, n))
    hi = F.greatest(lo, F.least(last, n))
    return F.slice(rows, lo, hi - lo + 1)


def window_around(rows: Column, line: Column, reach: int = 15) -> Column:
    return clamped_slice(rows, line - reach, line + reach)


def limited_lines(rows: Column, most: int = 40, more: str = "...") -> Column:
    """At most ``most`` lines, then an ellipsis line if any was cut."""
    return F.when(F.size(rows) > most, F.concat(F.slice(rows, 1, most), F.array(F.lit(more)))).otherwise(rows)


def highlight_spans(text: Column, needles: list[str]) -> Column:
    """First occurrence of each token, by start, claimed greedily without overlap:
    ``array<struct<start:int, length:int>>`` with 0-based starts."""
    found = F.array_sort(
        F.filter(
            F.array(*(F.struct((F.instr(F.lower(text), t) - 1).alias("start"), F.lit(len(t)).alias("length")) for t in dict.fromkeys(needles))),
            lambda s: s["start"] >= 0,
        )
    )
    empty = F.lit(None).cast("array<struct<start:int,length:int>>")
    return F.aggregate(
        found, F.coalesce(empty, F.array().cast("array<struct<start:int,length:int>>")),
        lambda kept, s: F.when(
            (F.size(kept) == 0) | (s["start"] >= F.element_at(kept, -1)["start"] + F.element_at(kept, -1)["length"]),
            F.concat(kept, F.array(s)),
        ).otherwise(kept),
    )


def rewrite_links(html: Column, component: str, package_version: str) -> Column:
    """Links of an embedded page of rendered documentation, ``href`` of ``a`` and ``src`` of
    ``img``, made to resolve from where it is embedded.

    ``../pkg-1.2/x`` and ``src/x`` go to the raw documentation's route, ``Data-Map.html`` to the
    module's page with its fragment, other plain ``.html`` pages to the raw route. Fragments,
    absolute links and those with a scheme stay, so rewriting twice changes nothing.
    """
    out = html
    for tag, attribute in (("a", "href"), ("img", "src")):
        lead = rf"""(?i)(<{tag}\b(?:[^>"']|"[^"]*"|'[^']*')*?\s{attribute}\s*=\s*["'])"""
        raw = f"/haddock/{package_version}/"
        # Dots of a sibling module's name are hyphens in its file name: one goes a round.
        module = rf"{lead}(?-i:([A-Z][^\"'/?#:-]*(?:-[^\"'/?#:-]*)*)\.html)(?=[#\"'])"
        out = F.regexp_replace(out, rf"{lead}\.\./(?=[^\"'/]*-[0-9][^\"'/-]*(?:/|[\"']))", "$1/haddock/")
        out = F.regexp_replace(out, rf"{lead}(?=src/)", f"$1{raw}")
        out = F.regexp_replace(out, module, f"$1/pkg/{component}/\u0001$2\u0002")
        out = F.regexp_replace(out, rf"{lead}(?=[^\"'/?#:]+\.html(?:[#\"']))", f"$1{raw}")
    pieces = F.split(out, "\u0001")
    dotted = F.transform(pieces, lambda p: F.when(p.contains("\u0002"), F.concat(F.replace(F.substring_index(p, "\u0002", 1), F.lit("-"), F.lit(".")), F.substring(p, F.length(F.substring_index(p, "\u0002", 1)) + 2, F.length(p)))).otherwise(p))
    return F.array_join(dotted, "")


def shell_quoted(word: Column) -> Column:
    """As is if it has letters, digits and ``-_./:@`` only, else in single quotes; so is an empty one."""
    quoted = F.concat(F.lit("'"), F.replace(word, F.lit("'"), F.lit("'\\''")), F.lit("'"))
    return F.when(word.rlike(r"^[\p{L}\p{N}_./:@-]+\z"), word).otherwise(quoted)


def percent_encoded(segment: Column) -> Column:
    """One path segment; unreserved characters and ``:@&=+$,`` stay."""
    out = F.url_encode(segment)
    kept = [(f"%{ord(c):02X}", c) for c in ":@&=+$,~"]
    for was, now in (("+", "%20"), ("*", "%2A"), *kept):
        out = F.replace(out, F.lit(was), F.lit(now))
    return out


#: Content types by file extension.
MIME = {
    "html": "text/html; charset=utf-8", "css": "text/css; charset=utf-8", "js": "application/javascript; charset=utf-8",
    "json": "application/json; charset=utf-8", "png": "image/png", "gif": "image/gif", "svg": "image/svg+xml",
    "woff": "font/woff", "woff2": "font/woff2", "txt": "text/plain; charset=utf-8",
}


def mime_type(path: Column) -> Column:
    """By what follows the last dot, whatever its case; else opaque bytes."""
    known = F.create_map(*(F.lit(x) for pair in MIME.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.lower(F.substring_index(path, ".", -1))), F.lit("application/octet-stream"))


def safe_segments(path: Column) -> Column:
    """No empty or hidden segment (so no ``.`` and ``..``), and no backslash or NUL."""
    return ~F.exists(F.split(path, "/"), lambda s: (s == "") | s.startswith(".") | s.contains("\\") | s.contains("\0"))


def needs_preprocessor(source: Column) -> Column:
    """A preprocessor pragma in the first 4096 characters, or a directive line there."""
    head = F.substring(source, 1, 4096)
    return head.rlike(r"(?i)\{-#\s*LANGUAGE[^#]*\bCPP\b") | head.rlike(r"(?m)^#\s*(if|ifdef|ifndef|include|define)\b")
