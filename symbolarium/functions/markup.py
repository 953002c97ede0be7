"""Two parsers that built-in functions cannot express, as UDFs. Rows go to Python by the hundred and
not in Arrow batches, which hold 10,000 rows whatever their size."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

_TAG = re.compile(r"<(/?)div\b([^>]*)>", re.IGNORECASE)


def div_slice_text(html: str | None, ident: str) -> str | None:
    """The inside of the first ``<div id="ident">``, nested divs kept; null if there is none,
    to the end if it never closes."""
    if html is None:
        return None
    depth, start = 0, None
    for tag in _TAG.finditer(html):
        if start is None:
            if not tag[1] and re.search(rf"""\bid\s*=\s*["']{re.escape(ident)}["']""", tag[2]):
                start, depth = tag.end(), 1
        else:
            depth += -1 if tag[1] else 1
            if not depth:
                return html[start : tag.start()]
    return None if start is None else html[start:]


def div_slice(html, ident: str):
    return F.udf(lambda h: div_slice_text(h, ident), "string", useArrow=False)(html)


_FIELD = re.compile(r"^(\s*)([A-Z][A-Za-z-]*)\s*:\s?(.*)$")
HEADER_TYPE = (
    "struct<description:string,copyright:string,license_form:string,license:string,maintainer:string,stability:string,"
    "portability:string,extra:array<struct<key:string,value:string>>,prose:string>"
)


def header_fields_of(text: str | None) -> dict:
    """``Key : value`` lines at a text's start. Deeper indented lines continue a value; the
    first line that is neither ends the block and the rest is prose. Of the three spellings of
    the licence field the first in order of preference wins; unknown keys keep their order."""
    lines = (text or "").split("\n")
    found: list[tuple[str, str]] = []
    indent, at = 0, 0
    while at < len(lines) and not lines[at].strip():
        at += 1
    while at < len(lines):
        line = lines[at]
        field = _FIELD.match(line)
        if found and line.strip() and len(line) - len(line.lstrip()) > indent:
            found[-1] = (found[-1][0], f"{found[-1][1]}\n{line.strip()}".strip())
        elif field:
            indent = len(field[1])
            found.append((field[2], field[3].strip()))
        elif line.strip() or not found:
            break
        else:
            at += 1
            break
        at += 1
    first: dict[str, str] = {}
    for key, value in found:
        first.setdefault(key, value)
    licence = next((k for k in ("SPDX-License-Identifier", "License", "Licence") if k in first), None)
    plain = {k: first.get(k.capitalize()) for k in ("copyright", "maintainer", "stability", "portability")}
    known = {"Module", "Description", "SPDX-License-Identifier", "License", "Licence", *(k.capitalize() for k in plain)}
    return {
        "description": first.get("Description"), **plain, "license_form": None if licence is None else "spdx" if licence.startswith("SPDX") else "plain",
        "license": first.get(licence) if licence else None, "extra": [{"key": k, "value": v} for k, v in found if k not in known],
        "prose": "\n".join(lines[at:]).strip() or None,
    }


def header_fields(text):
    return F.udf(header_fields_of, HEADER_TYPE, useArrow=False)(text)
