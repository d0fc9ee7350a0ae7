"""Line dedup against the plain definition."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from lendwell.llm import lines

BLANK = " \t\r\x0b\x0c"


def brute(rows, sites, least):
    spread = defaultdict(set)
    for _, text, source in rows:
        for line in (text or "").split("\n"):
            if len(line.split()) >= least:
                spread[line.strip(BLANK)].add(source)
    bad = {x for x, s in spread.items() if len(s) >= sites}
    out = []
    for doc, text, _ in rows:
        if text is None:
            out.append((doc, 0, 0, None))
            continue
        parts = text.split("\n")
        rest = [x for x in parts if x.strip(BLANK) not in bad]
        out.append((doc, len(parts), len(parts) - len(rest), "\n".join(rest)))
    return sorted(out, key=str)


def test_lines_equal_the_definition(spark):
    rng = random.Random(9)
    pool = [f"shared line number {i} here" for i in range(30)] + ["too short", "a  b\tc d", " a  b\tc d \r", "é ü ß ø", "w" * 5000]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 6))), rng.choice([None, "null", *"abcdefgh"])) for i in range(150)]
    rows += [(0, rows[0][1], "a"), (None, "too short", None), (1, None, "b"), (2, "", "c"), (2, "", "c")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, line string")
    for sites in (2, 6, 9):
        for least in (1, 4):
            got = lines.dedup_lines(df, sites=sites, least_words=least).collect()
            assert sorted(((r.doc_id, r.n_lines, r.n_removed, r.text) for r in got), key=str) == brute(rows, sites, least)


def test_wide_and_near_threshold_spreads(spark):
    """Sketches of thousands of sites: far lines by estimate, near ones by exact count."""
    spreads = {0: 5000, 1: 999, 2: 1000, 3: 1001, 4: 950, 5: 1050, 6: 400}
    df = spark.createDataFrame([(k, n) for k, n in spreads.items()], "line long, n int")
    seen = df.select("line", F.explode(F.sequence(F.lit(1), "n")).alias("site"), F.explode(F.array(F.lit(1), F.lit(2))).alias("again"))
    got = {r.line for r in lines.boilerplate(seen.select("line", "site"), 1000).collect()}
    assert got == {0, 2, 3, 5}


def test_documents_keep_their_columns(spark):
    rows = [(i, "one two three four\nown text " + str(i), "s" + str(i), 0) for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    out = lines.deduped_documents(df)
    assert out.columns == df.columns
    assert {(r.text, r.n_chars) for r in out.collect()} == {(f"own text {i}", 10) for i in range(9)}


def test_empty_table(spark):
    assert lines.dedup_lines(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_a_table_of_few_sites_asks_for_fewer(spark):
    wanted = []
    for n in (2, 5, 7, 12, 20, 300):
        df = spark.createDataFrame([(f"s{i}",) for i in range(n - 1)] + [(None,)], "source string")
        wanted.append(lines.sites_wanted(df))
    assert wanted == [3, 3, 3, 5, 8, 8]
    assert lines.sites_wanted(spark.createDataFrame([], "source string")) == 3
