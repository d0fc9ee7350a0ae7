"""Text, URL, identifier and citation expressions."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lendwell import fixed_values as fv
from lendwell.functions.cleaning import col, strip

# A bracketed id in any spelling, or a bare one that stands alone.
CITATION_IN_TEXT = r"(?U)\[\s*[Ss](\d+)\s*\]|(?<![\w\[])[Ss](\d+)(?![\w\]])"


def tidy_text(c: Column | str) -> Column:
    """No-break spaces and runs of blanks to one blank, at most one empty line, stripped."""
    text = F.regexp_replace(col(c), "[ \t\u00a0]+", " ")
    return strip(F.regexp_replace(text, "\n{3,}", "\n\n"))


def url_scheme(url: Column | str) -> Column:
    return F.lower(F.try_parse_url(col(url), F.lit("PROTOCOL")))


def url_host(url: Column | str) -> Column:
    return F.lower(F.try_parse_url(col(url), F.lit("HOST")))


def is_official(url: Column | str, hosts: Sequence[str] = fv.OFFICIAL_HOSTS) -> Column:
    """Https and a host of the allow-list; false for anything that does not parse."""
    ok = (url_scheme(url) == "https") & url_host(url).isin(*hosts)
    return F.coalesce(ok, F.lit(False))


def embedding_text(title: Column, section: Column, body: Column) -> Column:
    return F.concat_ws("\n", title, section, body)


def chunk_id(source: Column, index: Column) -> Column:
    """`source:0000`; the number grows past four digits instead of being cut."""
    return F.format_string("%s:%04d", source, index)


def point_id(chunk: Column | str) -> Column:
    """Name-based UUID (version 5) of a chunk id."""
    namespace = uuid.UUID(fv.POINT_NAMESPACE).hex
    name = F.encode(F.concat(F.lit(fv.POINT_PREFIX), col(chunk)), "UTF-8")
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), name))
    # Variant bits 10xx: keep the two low bits of the ninth byte's high nibble.
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    variant = F.lower(F.hex(nibble.bitwiseAND(3).bitwiseOR(8)))
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"),
        F.substring(digest, 9, 4), F.lit("-5"),
        F.substring(digest, 14, 3), F.lit("-"),
        variant, F.substring(digest, 18, 3), F.lit("-"),
        F.substring(digest, 21, 12),
    )


def citation_id(c: Column) -> Column:
    """Canonical `[S3]` for any spelling of a citation id; other text unchanged."""
    return F.regexp_replace(c, "(?U)" + fv.CITATION_ID, "[S$1]")


def citations_fixed(c: Column) -> Column:
    """Text with every citation in canonical form."""
    return F.regexp_replace(c, CITATION_IN_TEXT, "[S$1$2]")


def citations_changed(c: Column) -> Column:
    """How many citations in a text are not in canonical form."""
    found = F.regexp_extract_all(c, F.lit(CITATION_IN_TEXT), F.lit(0))
    return F.size(F.filter(found, lambda m: ~m.rlike(f"^{fv.CITATION_CANONICAL}$")))


def citations_in(c: Column) -> Column:
    """Canonical citations of a text, in order, with repeats."""
    return F.regexp_extract_all(c, F.lit("(?U)" + fv.CITATION_CANONICAL), F.lit(0))


def quoted_list(values: Column) -> Column:
    """An array of names printed as `['a', 'b']`."""
    return F.concat(
        F.lit("["),
        F.concat_ws(", ", F.transform(values, lambda v: F.concat(F.lit("'"), v, F.lit("'")))),
        F.lit("]"),
    )
