"""Fuzzy lines against all pairs; the main path runs no Python."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from fairsplit.llm import line_dedup
from llm_documents import prose, table


def brute(rows, size=line_dedup.SHINGLE):
    lines = [(i, j, line.strip(" \t\r\f\v").lower())
             for i, text in rows for j, line in enumerate((text or "").split("\n"))]
    lines = [x for x in lines if x[2]]
    sets = {x[2]: frozenset(x[2][k:k + size] for k in range(max(1, len(x[2]) - size + 1))) for x in lines}
    parent = {t: t for t in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                parent[root(a)] = root(b)
    first = {}
    for i, j, t in sorted(lines):
        first.setdefault(root(t), (i, j))
    gone = {(i, j) for i, j, t in lines if first[root(t)] != (i, j)}
    return {i: (None if text is None else "\n".join(
        x for j, x in enumerate(text.split("\n")) if (i, j) not in gone)) for i, text in rows}


def cases(draw):
    base = [prose(draw, 14) for _ in range(6)]
    near = [b[:40] + "x" + b[40:] for b in base]
    return [None, "", "\n\n", "short", "Short\n\nshort ", base[0], near[0] + "\n" + base[1], base[1].upper() + "\nnew",
            "\n".join(base[2:]), "\n".join(near[2:]) + "\n" + prose(draw, 9), prose(draw, 900), "ab\nab\ncd", near[0]]


def test_against_all_pairs(spark):
    draw = random.Random(4)
    rows = list(enumerate(cases(draw)))
    docs = table(spark, rows, ("gone", "line", "node", "place", "first"))
    got = line_dedup.deduplicate_lines(docs).collect()
    assert {r.doc_id: r.text for r in got} == brute(rows)
    kept = {r.doc_id: (r.n_lines, r.n_removed) for r in got}
    assert kept[0] == kept[1] == kept[2] == (0, 0) and kept[4] == (2, 2) and kept[11] == (3, 1)


def test_rows_of_one_id_and_missing_ids(spark):
    docs = table(spark, [(1, "same line here"), (1, "same line here"), (None, "same line here"), (2, "same line here")])
    got = line_dedup.deduplicate_lines(docs).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [
        (0, "same line here"), (1, "same line here"), (1, "same line here"), (2, "")]
    assert line_dedup.deduplicate_lines(docs.limit(0)).count() == 0


def test_long_lines_have_all_shingles(spark):
    draw = random.Random(6)
    text = "".join(draw.choice("abcdefgh ") for _ in range(9000)).strip()
    n = spark.createDataFrame([(text,), ("tiny",)], "t string").select(F.size(line_dedup.shingles(F.col("t"))).alias("n"))
    size = line_dedup.SHINGLE
    assert [r.n for r in n.collect()] == [len({text[i:i + size] for i in range(len(text) - size + 1)}), 1]


def test_no_python_on_the_main_path(spark):
    plan = line_dedup.deduplicate_lines(table(spark, ["a line of text", "b"]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_pairs_inside_a_large_family(spark):
    """Lines that share most of their text, few of them at the threshold; none is at an end of all its bands."""
    draw = random.Random(3)
    start = prose(draw, 40)
    own = [prose(draw, 6) for _ in range(120)]
    for i in range(0, 40, 2):
        own[119 - i] = own[i][:14] + own[119 - i][14:]
    rows = [(i, f"{start} {x}") for i, x in enumerate(own)]
    got = line_dedup.deduplicate_lines(table(spark, rows)).collect()
    assert {r.doc_id: r.text for r in got} == brute(rows)


def test_lines_without_word_breaks(spark):
    """Long unbroken runs of lower-case letters, one of them with other beginnings."""
    draw = random.Random(2)
    runs = ["".join(draw.choice("abcdefghijklmnopqrstuvw") for _ in range(300)) for _ in range(8)]
    rows = list(enumerate(runs + ["".join(draw.choice("abcdefg") for _ in range(9)) + r for r in runs]))
    got = line_dedup.deduplicate_lines(table(spark, rows)).collect()
    assert {r.doc_id: r.text for r in got} == brute(rows)


def test_lines_that_share_too_little_are_not_ranked(spark, monkeypatch):
    """Of a family with one common passage, only the lines that share most of their shingles go on to the exact join."""
    draw = random.Random(8)
    start = prose(draw, 12)
    apart = [f"{start} {prose(draw, 60)}" for _ in range(20)]
    alike = f"{start} {prose(draw, 60)}"
    lines = spark.createDataFrame([(x.lower(),) for x in [*apart, alike, alike + " end"]], "line string")
    crowd = lines.select(F.xxhash64("line").alias("node"), F.xxhash64("line").alias("c"))
    ranked = []
    stored = line_dedup.stored
    monkeypatch.setattr(line_dedup, "stored", lambda df, name: ranked.append(
        (name, stored(df, name))) or ranked[-1][1])
    monkeypatch.setattr(line_dedup, "discard", lambda *tables: None)
    pairs = line_dedup.rarest_pairs(lines, crowd, 80).collect()
    assert dict(ranked)["rarest"].select("node").distinct().count() == 2
    assert len(pairs) == 1


def test_bands_need_few_hashes(spark):
    """A line of words has a mark for each; unbroken text has all its shingles, whatever words stand beside it."""
    draw = random.Random(12)
    run = "".join(draw.choice("abcdefgh") for _ in range(90))
    words = prose(draw, 60).lower()
    rows = spark.createDataFrame([(words,), (run,), (f"{words} {run}",)], "t string")
    of_words, of_run, both = (set(r[0]) for r in rows.select(line_dedup.marks(F.col("t"))).collect())
    assert len(of_words) <= 60 and len(of_run) == 79
    assert of_run <= both and len(of_words & both) >= len(of_words) - 1


def test_small_bands_are_compared_in_whole(spark, monkeypatch):
    """Pairs of lines inside a band of a few lines are found without the exact join."""
    monkeypatch.setattr(line_dedup, "rarest_pairs", None)
    draw = random.Random(9)
    start = prose(draw, 40)
    own = [prose(draw, 6) for _ in range(9)]
    own[5] = own[3][:14] + own[5][14:]
    rows = [(i, f"{start} {x}") for i, x in enumerate(own)]
    got = line_dedup.deduplicate_lines(table(spark, rows)).collect()
    assert {r.doc_id: r.text for r in got} == brute(rows)


def test_lines_are_read_once_for_all_comparisons(spark, monkeypatch):
    names, real = [], line_dedup.stored
    monkeypatch.setattr(line_dedup, "stored", lambda df, name: names.append(name) or real(df, name))
    draw = random.Random(3)
    start = prose(draw, 40)
    rows = [(i, f"{start} {prose(draw, 6)}") for i in range(30)]
    line_dedup.similar_lines(line_dedup.lines_of(table(spark, rows), "doc_id", "text")).collect()
    assert names.count("confirmed") > 1 and names.count("ends") == 1


def test_short_lines_with_another_ending_share_a_band(spark):
    draw = random.Random(21)
    lines = [prose(draw, 6).lower() for _ in range(40)]
    rows = spark.createDataFrame([(2 * i + k, x + "mbqk" * k) for i, x in enumerate(lines) for k in (0, 1)], "id long, t string")
    keys = {}
    for r in line_dedup.band_keys(rows, "t").collect():
        keys.setdefault(r.id, set()).update(r["keys"])
    assert all(keys[2 * i] & keys[2 * i + 1] for i in range(len(lines)))
    both = spark.createDataFrame([("ab " * n,) for n in (20, 50, 90)], "t string")
    kinds = line_dedup.band_keys(both.withColumn("n", F.length("t")), "t").select("n", "fine").collect()
    assert sorted(map(tuple, kinds)) == [(60, True), (150, False), (150, True), (270, False)]


def test_likely_rows_by_a_small_bitmap(spark, tmp_path):
    """Every row of the table passes, about one in 16 of the others, and the broadcast has a row for 64 places."""
    spark.range(4000).select(F.xxhash64("id").alias("node")).write.parquet(str(tmp_path / "small"))
    small = spark.read.parquet(str(tmp_path / "small"))
    big = spark.range(40000).select("id", F.xxhash64("id").alias("node"))
    found = line_dedup.likely(big, small, "node")
    ids = [r.id for r in found.collect()]
    assert found.columns == big.columns and len(ids) == len(set(ids)) and set(range(4000)) <= set(ids)
    assert 0.04 < (len(ids) - 4000) / 36000 < 0.08
    assert line_dedup.likely(big, small.limit(0), "node").count() == 0


def test_tables_beyond_the_broadcast_bound(spark, monkeypatch):
    """The same lines go if no table of lines or bands may be broadcast, nor a bitmap."""
    rows = list(enumerate(cases(random.Random(4))))
    bounds = []
    attached = line_dedup.attached
    monkeypatch.setattr(line_dedup, "attached", lambda *a, **b: bounds.append(b.get("limit")) or attached(*a, **b))
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
    got = line_dedup.deduplicate_lines(table(spark, rows)).collect()
    assert {r.doc_id: r.text for r in got} == brute(rows) and bounds.count(0) >= 3


def test_lines_are_split_twice(spark, monkeypatch):
    """Once for their bands, which hold their place too, and once for the texts that are compared."""
    names, real = [], line_dedup.stored
    monkeypatch.setattr(line_dedup, "stored", lambda df, name: names.append((name, df.count() if name == "line-bands" else 0)) or real(df, name))
    short, middle, long = "a line", "ab " * 50, "ab " * 90
    docs = table(spark, [(1, f"{short}\n{middle}\n{long}"), (2, f"{short}\n\n{long}")])
    kept = {r.doc_id: (r.n_lines, r.n_removed) for r in line_dedup.deduplicate_lines(docs).collect()}
    assert "lines" not in dict(names) and dict(names)["line-bands"] == 6 and kept == {1: (3, 1), 2: (2, 2)}


def test_few_ties_are_compared_by_their_shingles(spark, monkeypatch):
    """Of lines with a common start, bitmaps rule out the pairs far below the threshold, and none at it or above."""
    draw = random.Random(5)
    start = prose(draw, 40)
    rows = [(i, f"{start} {prose(draw, 30)}") for i in range(20)]
    rows += [(20 + i, text + " and more") for i, (_, text) in enumerate(rows[:5])]
    compared, real = [], line_dedup.confirmed_ties
    monkeypatch.setattr(line_dedup, "confirmed_ties", lambda texts, ties, percent: compared.append(ties.count()) or real(texts, ties, percent))
    got = line_dedup.deduplicate_lines(table(spark, rows)).collect()
    assert {r.doc_id: r.text for r in got} == brute(rows) and 0 < sum(compared) <= 20


def test_bitmaps_keep_every_pair_at_the_threshold(spark):
    """Lines with ever more other words, some of repeated words and some of other letters: the bound never exceeds what differs."""
    draw = random.Random(7)
    base, lines = prose(draw, 60).lower().split(" "), ["ab " * 60 + "cd", "ab " * 70 + "cd", "é" * 40, "é" * 41 + "x", "tiny", "tony"]
    for n in range(30):
        lines.append(" ".join(prose(draw, 1).lower() if i < n else word for i, word in enumerate(base)))
    sets = [{x[k:k + line_dedup.SHINGLE] for k in range(max(1, len(x) - line_dedup.SHINGLE + 1))} for x in lines]
    alike = {(i, j) for j in range(len(lines)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    texts = line_dedup.stored(spark.createDataFrame(list(enumerate(lines)), "node long, line string"), "some")
    ids = texts.select("node")
    ties = line_dedup.stored(ids.crossJoin(ids.select(F.col("node").alias("b"))).where("node < b").withColumnRenamed("node", "a"), "all")
    bitmaps = line_dedup.line_bitmaps(texts, ids)
    found = {(r.a, r.b) for r in line_dedup.possible_ties(bitmaps, ties, 80).collect()}
    assert alike <= found and len(found) < ties.count() / 2
    assert {(r.a, r.b) for r in line_dedup.confirmed_ties(texts, ties, 80).collect()} == alike


def test_lines_are_trimmed_where_they_have_blanks(spark):
    blanks = [" ", "\t", "\r", "\f", "\v", ""]
    texts = [a + b + core + b + a for a in blanks for b in blanks for core in ("", "x", "a b", "é\tz")] + [" x "]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", line_dedup.trimmed(F.col("t")).alias("u")).collect()
    assert all(r.u == r.t.strip(" \t\r\f\v") for r in got)
