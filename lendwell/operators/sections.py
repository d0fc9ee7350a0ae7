"""HTML pages to headed sections, and sections to overlapping word chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lendwell import fixed_values as fv
from lendwell.functions.text import chunk_id
from lendwell.operators.ranking import running_sum

SKIPPED = frozenset(("script", "style", "nav", "header", "footer", "form", "noscript", "svg"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4"))
BLOCKS = HEADINGS | {"p", "li"}
VOID = frozenset(
    "area base br col embed hr img input link meta source track wbr".split()
)


class _Outline(HTMLParser):
    """Collects the text blocks of one page in document order.

    A block is the text directly governed by a heading, paragraph or list item.
    Text inside a nested block belongs to the inner one only, and a new block
    ends an open paragraph, so every text occurs once even where tags are not
    closed. Blocks know whether they lie in the page's main part.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, list[str], bool]] = []
        self.stack: list[tuple[str, list[str] | None]] = []
        self.root_at: int | None = None
        self.root_seen = False
        self.skip_at: int | None = None

    def _close(self, position: int) -> None:
        del self.stack[position:]
        if self.root_at is not None and position <= self.root_at:
            self.root_at = None
        if self.skip_at is not None and position <= self.skip_at:
            self.skip_at = None

    def _innermost(self, tags) -> int | None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in tags:
                return i
        return None

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        if tag in BLOCKS:
            block = self._innermost(BLOCKS)
            if block is not None and self.stack[block][0] == "p":
                self._close(block)
        if tag == "li":
            item = self._innermost(("li", "ul", "ol"))
            if item is not None and self.stack[item][0] == "li":
                self._close(item)
        place = len(self.stack)
        if tag in SKIPPED and self.skip_at is None:
            self.skip_at = place
        main = tag in ("main", "article") or dict(attrs).get("role") == "main"
        if main and not self.root_seen and self.skip_at is None:
            self.root_seen, self.root_at = True, place
        parts = None
        if tag in BLOCKS and self.skip_at is None:
            parts = []
            self.blocks.append((tag, parts, self.root_at is not None))
        self.stack.append((tag, parts))

    def handle_endtag(self, tag):
        place = self._innermost((tag,))
        if place is not None:
            self._close(place)

    def handle_data(self, data):
        if self.skip_at is None:
            block = self._innermost(BLOCKS)
            if block is not None and self.stack[block][1] is not None:
                self.stack[block][1].append(data)


def _tidy(parts: Sequence[str]) -> str:
    """Stripped non-empty pieces joined by blanks, blanks collapsed."""
    text = " ".join(p.strip() for p in parts if p.strip())
    text = re.sub(r"[ \t\u00a0]+", " ", text)
    return _tidy_lines([text])


def outline(html: str, title: str) -> list[tuple[str, str]]:
    """(heading, text) sections of one page, in order."""
    parser = _Outline()
    parser.feed(html)
    parser.close()
    sections: list[tuple[str, list[str]]] = [(title, [])]
    for tag, parts, in_root in parser.blocks:
        text = _tidy(parts)
        if not text or (parser.root_seen and not in_root):
            continue
        if tag in HEADINGS:
            sections.append((text, []))
        else:
            sections[-1][1].append(text)
    return [(heading, _tidy_lines(lines)) for heading, lines in sections if lines]


def _tidy_lines(lines: Sequence[str]) -> str:
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def html_sections(
    pages: DataFrame, key: str, html: str, title: str, keep: Sequence[str] = ()
) -> DataFrame:
    """One row per section of a page: key, section number from 0, heading, text."""
    rows = pages.select(key, *keep, F.col(title).alias("_title"), F.col(html).alias("_html"))
    added = T.StructType().add("section_no", "long").add("page_or_section", "string")
    added = added.add("text", "string")
    schema = T.StructType(rows.drop("_title", "_html").schema.fields + added.fields)
    names = [key, *keep]

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [
                [*row[:-2], number, heading, text]
                for row in batch[[*names, "_title", "_html"]].itertuples(index=False)
                for number, (heading, text) in enumerate(
                    outline(row[-1] or "", row[-2] or "")
                )
            ]
            yield pd.DataFrame(found, columns=[*names, "section_no", "page_or_section", "text"])

    return rows.mapInPandas(kernel, schema)


# --- chunks --------------------------------------------------------------


def word_chunks(text: str, limit: int, overlap: int) -> list[str]:
    """Windows of whole words, at most `limit` characters wide.

    A window takes all words whose ends lie within `limit` of its first word's
    start; the next begins with the last word that leaves `overlap` characters
    repeated, and one word on at least. Word ends are searched, not walked. A
    word longer than the limit stands alone.
    """
    words = text.split()
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    starts = ends - sizes
    out, at = [], 0
    while at < len(words):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + limit + 1, side="right")))
        out.append(" ".join(words[at:to]))
        if to >= len(words):
            return out
        repeat = int(np.searchsorted(starts, ends[to - 1] - overlap, side="right")) - 1 if overlap else to
        at = max(at + 1, min(repeat, to))
    return out


def chunk_texts(text: Column, limit: int = fv.CHUNK_CHARS, overlap: int = fv.CHUNK_OVERLAP) -> Column:
    if limit <= 0 or not 0 <= overlap < limit:
        raise ValueError("chunk size must be positive and larger than the overlap")

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: word_chunks(t or "", limit, overlap))

    return split(text)


def number_parts(
    sections: DataFrame, source: str, section_no: str, parts: str, keep: Sequence[str] = ()
) -> DataFrame:
    """Explode an array of parts and number them through their source from 0.

    Only section lengths are summed up in section order; a source with a third
    of all sections is spread over many section buckets.
    """
    sized = sections.withColumn("_n", F.size(parts).cast("bigint")).where(F.col("_n") > 0)
    placed = running_sum(sized, [source], section_no, {"_n": "_upto"})
    return placed.select(
        source,
        section_no,
        *keep,
        (F.col("_upto") - F.col("_n")).alias("_from"),
        F.posexplode(parts).alias("part_no", "text"),
    ).select(
        chunk_id(F.col(source), F.col("_from") + F.col("part_no")).alias("chunk_id"),
        source,
        section_no,
        "part_no",
        *keep,
        "text",
    )


def make_chunks(
    sections: DataFrame,
    source: str = "source_id",
    section_no: str = "section_no",
    text: str = "text",
    keep: Sequence[str] = (),
    limit: int = fv.CHUNK_CHARS,
    overlap: int = fv.CHUNK_OVERLAP,
) -> DataFrame:
    """Chunks of every section with ids `source:0000` running through the source.

    `section_no` must be unique within a source.
    """
    parts = sections.select(
        source, section_no, *keep, chunk_texts(F.col(text), limit, overlap).alias("_parts")
    )
    return number_parts(parts, source, section_no, "_parts", keep)


def union_sections(*kinds: DataFrame) -> DataFrame:
    """All sections of several document kinds, columns matched by name."""
    first, *rest = kinds
    for other in rest:
        first = first.unionByName(other)
    return first


def missing_sources(expected: DataFrame, sections: DataFrame, source: str) -> DataFrame:
    """Expected sources that gave no section at all."""
    return expected.select(source).join(sections.select(source), source, "left_anti")


def require_sources(expected: DataFrame, sections: DataFrame, source: str) -> None:
    lost = missing_sources(expected, sections, source).limit(10).collect()
    if lost:
        raise ValueError(f"no sections for sources {sorted(r[0] for r in lost)}")
