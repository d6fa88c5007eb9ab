"""Fuzzy line deduplication by MinHash, as DataFrame operations only.

A line is lower-cased and trimmed; its shingles are the runs of ``SHINGLE``
characters. Bands are taken from fewer hashes, its marks: one for each two words in a
row, which are about as long as a shingle, and all shingles of a word that is longer
than two shingles; a short line has all its shingles there. One hash per mark is enough for all bands: the sorted hashes lie on
a circle, and a band is the ``ROWS`` next ones after one of ``BANDS`` fixed points,
which is the minimum under a shifted order, then the second, and so on. Lines that
share a band are tied to the smallest line of that band, each tie is confirmed by the
exact Jaccard similarity of the shingle sets, unless bitmaps of the two sets show that
they differ too much, which rules out most ties for less. Of a band of up to
``REGION`` lines that is not one component by then all other pairs are compared. Lines
of a larger one are put in order by their further bands and tied to their
neighbours; what is still apart is joined exactly by its rarest shingles, of which a
pair at the threshold shares one. Of every component of confirmed ties one line
stays: the first by document and place.

Equal lines are one node from the start; every aggregate combines map-side, so a
line, or a family of lines, with a third of all rows costs a row per task. Lines
are numbered by a 64-bit hash of their text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import discard
from .common import BROADCAST_ROWS, attached, stored
from .components import components

BLANKS = " \t\r\f\v"
SHINGLE = 12
BANDS, ROWS = 12, 3
PERCENT = 80
#: Lines of a band that are compared with each other; more are put in order, then joined by their rarest shingles.
REGION = 12
#: Lines of up to so many characters have bands of all their shingles, from so many on bands of their marks; those between, both.
FINE, COARSE = 160, 128
#: Neighbours in an order are compared up to this distance, and if so many of their bands are equal.
NEAR, EQUAL_BANDS = 4, 4
#: 64-bit words of a line's bitmap, which rules out most ties before their shingles are compared.
WORDS = 32
#: The band points, in order.
_POINTS = [(j << 64) // BANDS - (1 << 63) for j in range(BANDS)]
_KEYS = [f"k{i}" for i in range(BANDS)]
#: Tables of lines and bands are broadcast up to so many counted rows, which is some 15 MB of the driver's memory each.
BROADCAST_LINES = 250_000


def normal(line: Column) -> Column:
    return F.lower(trimmed(line))


def trimmed(line: Column) -> Column:
    """``line`` without blanks at its ends; few lines have any, and trimming looks at every character."""
    ends = reduce(Column.__or__, [at(line, F.lit(blank)) for blank in BLANKS for at in (F.startswith, F.endswith)])
    return F.when(ends, F.btrim(line, F.lit(BLANKS))).otherwise(line)


def shingles(line: Column) -> Column:
    """Distinct 64-bit hashes of a line's shingles; a shorter line is one shingle.

    Four bytes per character make a shingle a slice at a known place. The one-element array binds these
    bytes, which the optimizer would else compute again for every shingle.
    """
    width = 4 * SHINGLE

    def hashes(code: Column) -> Column:
        last = F.greatest(F.lit(1), F.octet_length(code) - F.lit(width - 1))
        return F.transform(F.sequence(F.lit(1), last, F.lit(4)), lambda i: F.xxhash64(F.substr(code, i, F.lit(width))))

    return F.array_distinct(F.flatten(F.transform(F.array(F.encode(line, "UTF-32")), hashes)))


def marks(line: Column) -> Column:
    """Distinct 64-bit hashes of each two words in a row, and of the shingles of words longer than two shingles."""
    def each(words: Column) -> Column:
        return F.transform(words, lambda word, i: F.xxhash64(word, F.get(words, i + 1)))

    def cut(words: Column) -> Column:
        return F.flatten(F.transform(words, lambda word, i: F.when(
            F.length(word) > 2 * SHINGLE, shingles(word)).otherwise(F.array(F.xxhash64(word, F.get(words, i + 1))))))

    def hashes(words: Column) -> Column:
        # Bytes are at hand, characters have to be counted.
        long = F.exists(words, lambda word: (F.octet_length(word) > 2 * SHINGLE) & (F.length(word) > 2 * SHINGLE))
        return F.when(long, cut(words)).otherwise(each(words))

    return F.array_distinct(F.flatten(F.transform(F.array(F.split(line, " ")), hashes)))


def band_keys(lines: DataFrame, line: str) -> DataFrame:
    """The other columns, ``fine`` and ``keys``: one per band point, of the next ``ROWS`` hashes on the circle.

    A short line has few marks, so its shingles are taken (``fine``); a line of middling length has a row of each kind.

    The points are sorted in among the hashes; the place of point j less the j points before it is the place of
    the next hash. The beginning of the circle is repeated at its end. Each step is a column that the next
    one uses more than once, so that none is computed once per band.
    """
    rest = [*(c for c in lines.columns if c != line), "fine"]
    size = F.length(line)
    kinds = F.when(size < COARSE, F.array(F.lit(True))).when(size > FINE, F.array(F.lit(False))).otherwise(
        F.array(F.lit(True), F.lit(False)))
    lines = lines.withColumn("fine", F.explode(kinds))
    real = lines.select(*rest, F.sort_array(F.when(F.col("fine"), shingles(F.col(line))).otherwise(
        marks(F.col(line)))).alias("_real"))
    both = real.select(*rest, F.concat("_real", F.slice("_real", 1, ROWS)).alias("_ring"),
                       F.sort_array(F.concat("_real", F.array(*(F.lit(p) for p in _POINTS)))).alias("_all"))

    def key(j: int, point: int) -> Column:
        start = F.array_position("_all", F.lit(point)).cast("int") - F.lit(j)
        return F.xxhash64(F.lit(point), F.slice("_ring", start, F.lit(ROWS)))

    return both.select(*rest, F.array(*(key(j, p) for j, p in enumerate(_POINTS))).alias("keys"))


def lines_of(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """doc_id, place and line of every line that is not blank."""
    return (docs.where(F.col(id_column).isNotNull())
            .select(F.col(id_column).alias("doc_id"), F.posexplode(F.split(F.col(text), "\n")).alias("place", "line"))
            .where(trimmed(F.col("line")) != "").withColumn("line", normal(F.col("line"))))


def likely(big: DataFrame, small: DataFrame, on: str) -> DataFrame:
    """Rows of ``big`` whose ``on``, a 64-bit hash, is in the stored table ``small``, and about one in 16 of the others.

    What is broadcast is a bitmap, 64 places to a row and 16 places per counted row of ``small``: a few bytes of the
    driver's memory per row instead of some fifty. A larger one than ``BROADCAST_ROWS`` is no longer broadcast.
    """
    words = small.count() // 4 + 1
    if words > BROADCAST_ROWS:
        return big.join(small.select(on).hint("merge"), on, "left_semi")

    def word(of: str) -> Column:
        return F.expr(f"shiftright(pmod(`{of}`, {64 * words}L), 6)").alias("_word")

    def bit(of: str) -> Column:
        return F.expr(f"shiftleft(1L, cast(`{of}` & 63L as int))")

    bitmap = small.select(word(on), bit(on).alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    found = big.select("*", word(on)).join(F.broadcast(bitmap), "_word").where(F.col("_bits").bitwiseAND(bit(on)) != 0)
    return found.select(*big.columns)


def line_texts(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node`` and ``line`` of the ``nodes``, and of a few others, stored; a hot line is one row per task before it is shuffled."""
    texts = lines.select(F.xxhash64("line").alias("node"), "line")
    return stored(likely(texts, nodes, "node").groupBy("node").agg(F.min("line").alias("line")), "texts")


def line_bitmaps(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node``, ``most`` (shingles, repeated ones included) and ``bits`` of the ``nodes``, stored.

    Each shingle sets one of ``64 * WORDS`` places by its hash. A row per shingle keeps this in generated code.
    """
    code = texts.join(nodes.hint("merge"), "node").select("node", F.encode("line", "UTF-32").alias("code"))
    width = 4 * SHINGLE
    last = F.greatest(F.lit(1), F.octet_length("code") - F.lit(width - 1))
    each = code.select("node", "code", F.explode(F.sequence(F.lit(1), last, F.lit(4))).alias("at"))
    hashed = each.select("node", F.xxhash64(F.substr("code", F.col("at"), F.lit(width))).alias("hash"))
    bit = "shiftleft(1L, cast(hash & 63L as int))"
    # Four words to a row, as a column each: few groups for the shingles, and few rows for the aggregate of many columns.
    fours = hashed.groupBy("node", F.expr(f"pmod(shiftright(hash, 8), {WORDS // 4}L)").alias("four")).agg(
        *(F.bit_or(F.expr(f"if((shiftright(hash, 6) & 3L) = {k}L, {bit}, 0L)")).alias(f"w{k}") for k in range(4)),
        F.count("*").alias("n"))
    whole = [F.coalesce(F.max(F.when(F.col("four") == i, F.col(f"w{k}"))), F.lit(0)) for i in range(WORDS // 4) for k in range(4)]
    return stored(fours.groupBy("node").agg(F.sum("n").alias("most"), F.array(*whole).alias("bits")), "bitmaps")


def with_ends(ties: DataFrame, rows: DataFrame) -> DataFrame:
    """The ``ties`` with the other columns of ``rows`` (by ``node``) for their ends, as structs ``x`` and ``y``; nothing is broadcast."""
    for end, side in (("a", "x"), ("b", "y")):
        ties = ties.join(rows.select(F.col("node").alias(end), F.struct(*(c for c in rows.columns if c != "node")).alias(side)).hint("merge"), end)
    return ties


def possible_ties(bitmaps: DataFrame, ties: DataFrame, percent: int) -> DataFrame:
    """The ties less those that cannot reach ``percent``, stored.

    A place that only one of two bitmaps has is a shingle that only this line has, so at least as many shingles
    differ. Of n shingles in both sets together, d of which differ, (n - d) / (n + d) is the similarity.
    """
    # Functions of arrays, as the words one by one make more code than the JVM compiles.
    words = F.zip_with("x.bits", "y.bits", lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    differ = F.aggregate(words, F.lit(0), lambda total, n: total + n)
    able = (100 + percent) * differ <= (100 - percent) * (F.col("x.most") + F.col("y.most"))
    return stored(with_ends(ties, bitmaps).where(able).select("a", "b"), "possible")


def confirmed_ties(texts: DataFrame, ties: DataFrame, percent: int) -> DataFrame:
    """The ties whose lines, of ``texts`` (node, line), share at least ``percent`` of the union of their shingles."""
    # Stored with its result: a filter here would be pushed down and take the shingles several times.
    judged = (with_ends(ties, texts)
              .select("a", "b", shingles(F.col("x.line")).alias("x"), shingles(F.col("y.line")).alias("y"))
              .withColumn("n", F.size(F.array_intersect("x", "y")))
              .select("a", "b", (100 * F.col("n") >= percent * (F.size("x") + F.size("y") - F.col("n"))).alias("alike")))
    return stored(judged, "confirmed").where("alike").select("a", "b")


def pairs_of_bands(rows: DataFrame) -> DataFrame:
    """Pairs of lines of different components in each band, less those of its smallest line, which were compared.

    ``rows`` has ``node``, ``c`` (component), ``key`` and the smallest line ``low``, for bands of at most ``REGION`` lines.
    """
    inner = rows.where("node != low").groupBy("key").agg(F.collect_list(F.struct("node", "c")).alias("all"))
    one = inner.select(F.explode("all").alias("x"), "all").select("x", F.explode("all").alias("y"))
    return one.where("x.node < y.node AND x.c != y.c").select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def neighbours(rows: DataFrame) -> DataFrame:
    """Ties of lines that lie near each other in one band, in the order of the bands that follow it.

    ``rows`` has ``node``, ``c`` (component) and the bands ``keys``. Lines that share further bands are likely alike, so this joins most
    of a large family before any pairs are formed. The order is dealt by range, so a band of any size is
    spread; a tie over the edge of two ranges, or of lines with few equal bands, is left to the exact join.
    """
    follow = [F.get("keys", (F.col("j") + i) % BANDS).alias(f"f{i}") for i in range(4)]
    banded = rows.select("node", "c", "keys", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("j"))
    order = [f"f{i}" for i in range(4)] + ["node"]
    ranged = banded.select("node", "c", "keys", *follow).repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    before = Window.partitionBy("part").orderBy(*order)
    near = ranged.select("node", "c", "keys", "f0", F.array(*[
        F.lag(F.struct("node", "c", "keys", "f0"), i).over(before) for i in range(1, NEAR + 1)]).alias("near"))
    pairs = near.select("node", "c", "keys", "f0", F.explode("near").alias("b")).where("b.f0 = f0 AND b.c != c")
    equal = F.size(F.filter(F.zip_with("keys", "b.keys", lambda x, y: x == y), lambda same: same))
    return pairs.where(equal >= EQUAL_BANDS).select(
        F.least("node", "b.node").alias("a"), F.greatest("node", "b.node").alias("b")).distinct()


def rarest_pairs(lines: DataFrame, crowd: DataFrame, percent: int) -> DataFrame:
    """All pairs of lines of different components that can reach ``percent``.

    Two sets at the threshold share ``percent`` of the larger and 2 ``percent`` / (100 + ``percent``) of the
    smaller one at least. With shingles in one order, the rarest first, a set less that overlap and one more
    is a prefix that meets the other's, and the rest after the first common place bounds what they share.

    Shingles of one component come first in that order and have no pairs, so their number is enough; a line
    of which they leave less than ``percent`` has no partner at all.
    """
    texts = line_texts(lines, crowd.select("node"))
    sets = stored(attached(texts, crowd, "node").select("node", "c", shingles(F.col("line")).alias("all"))
                  .select("node", "c", F.size("all").alias("n"), "all"), "crowded-shingles")
    discard(texts)
    live = stored(sets.select("c", F.explode("all").alias("shingle")).groupBy("shingle")
                  .agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("often"))
                  .where("low != high").select("shingle", "often"), "often")
    n = F.col("n")
    met = (attached(sets.select("node", "n", F.explode("all").alias("shingle")), live.select("shingle"), "shingle", limit=BROADCAST_LINES)
           .groupBy("node", "n").agg(F.count("*").alias("shared")))
    able = stored(met.where(100 * F.col("shared") >= percent * n).select("node", (n - F.col("shared")).alias("alone")), "able")
    place = F.row_number().over(Window.partitionBy("node").orderBy("often", "shingle")) + F.col("alone") - 1
    each = attached(sets, able, "node").select("node", "c", "n", "alone", F.explode("all").alias("shingle"))
    ranked = (attached(each, live, "shingle", limit=BROADCAST_LINES).withColumn("place", place)
              .where(F.col("place") <= n - F.ceil(percent * n / 100))
              .withColumn("small", F.col("place") <= n - F.ceil(2 * percent * n / (100 + percent))))
    ranked = stored(ranked.select("shingle", "node", "c", "n", "place", "small"), "rarest")
    discard(sets, live, able)
    # A shingle of one component has no pairs: a family that is tied goes no further.
    live = ranked.groupBy("shingle").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.max("small").alias("paired"))
    every, ranked = ranked, stored(
        ranked.join(live.where("low != high and paired").select("shingle").hint("merge"), "shingle"), "open-rarest")
    discard(every)
    x, y = ranked.alias("x"), ranked.where("small").alias("y")
    most = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    met = x.join(y.hint("merge"), F.col("x.shingle") == F.col("y.shingle")).where(
        (F.col("x.c") != F.col("y.c")) & (F.struct("y.n", "y.node") < F.struct("x.n", "x.node"))
        & (100 * F.col("y.n") >= percent * F.col("x.n"))
        & ((100 + percent) * most >= percent * (F.col("x.n") + F.col("y.n"))))
    pairs = stored(met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
                   .distinct(), "crowded-ties")
    discard(ranked)
    return pairs


def banded_lines(lines: DataFrame) -> DataFrame:
    """doc_id, place, ``node`` (the line's hash) and bands of every line, stored; a line of middling length has two rows.

    ``listed`` marks one row of each line. Equal lines have a row each: they come together when bands are counted.
    """
    keyed = band_keys(lines.select("doc_id", "place", F.xxhash64("line").alias("node"), "line",
                                   (F.length("line") > FINE).alias("coarse")), "line")
    keys = (F.col("keys")[i].alias(name) for i, name in enumerate(_KEYS))
    return stored(keyed.select("doc_id", "place", "node", (F.col("fine") | F.col("coarse")).alias("listed"), *keys), "line-bands")


def similar_lines(lines: DataFrame, percent: int = PERCENT, banded: DataFrame | None = None) -> DataFrame:
    """``node`` and ``component`` of lines that are tied to a smaller one; nodes are hashes of the line.

    ``banded`` is what ``banded_lines`` stored of ``lines``, if that is there already.
    """
    nodes = banded_lines(lines) if banded is None else banded
    rows = nodes.select("node", F.explode(F.array(*_KEYS)).alias("key"))
    shared = stored(rows.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"))
                    .where("low != high").select("key"), "shared-bands")
    # Bands of one line that the bitmap lets through have equal ends and go with them.
    found = stored(likely(rows, shared, "key").distinct(), "found")
    ends = stored(found.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high"))
                  .where("low != high"), "band-ends")
    members = stored(attached(found, ends, "key", limit=BROADCAST_LINES), "members")
    discard(shared, found, ends)
    # The only lines that are compared from here on; their texts are looked up once.
    compared = stored(members.select("node").distinct(), "ends")
    texts = line_texts(lines, compared)
    bitmaps = line_bitmaps(texts, compared)
    ties = stored(members.where("node != low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct(), "ties")
    possible = possible_ties(bitmaps, ties, percent)
    links = confirmed_ties(texts, possible, percent)
    tied = components(links)
    discard(ties, possible, links, compared)
    # Of a band of two lines that is the only pair; of more, others were not compared.
    for step in ("near", "exact"):
        crowd = _crowded(members.where(F.col("n") > (2 if step == "near" else REGION)), tied)
        if crowd is None:
            continue
        if step == "near":
            large = crowd.where(F.col("n") > REGION)
            keyed = attached(nodes, stored(large.select("node", "c").distinct(), "crowded-lines"), "node", limit=BROADCAST_LINES)
            keyed = keyed.select("node", "c", *_KEYS).distinct()
            ties = stored(pairs_of_bands(crowd.where(F.col("n") <= REGION)).unionAll(
                neighbours(keyed.select("node", "c", F.array(*_KEYS).alias("keys")))), "near-pairs")
        else:
            ties = rarest_pairs(texts.select("line"), stored(crowd.select("node", "c").distinct(), "crowded-lines"), percent)
        possible = possible_ties(bitmaps, ties, percent)
        links = confirmed_ties(texts, possible, percent)
        stars = tied.select(F.col("component").alias("a"), F.col("node").alias("b"))
        wider = components(stars.unionAll(links))
        discard(crowd, ties, possible, links, tied)
        tied = wider
    discard(members, texts, bitmaps)
    if banded is None:
        discard(nodes)
    return tied


def _crowded(members: DataFrame, tied: DataFrame) -> DataFrame | None:
    """The rows of ``members`` (node, key, n, low) of bands that are not one component, with their component ``c``."""
    apart = attached(members, tied, "node", "left", limit=BROADCAST_LINES).select("node", "key", "n", "low", F.coalesce("component", "node").alias("c"))
    open_ = stored(apart.groupBy("key").agg(F.min("c").alias("first"), F.max("c").alias("last"))
                   .where("first != last").select("key"), "open-bands")
    if open_.isEmpty():
        discard(open_)
        return None
    crowd = stored(attached(apart, open_, "key", limit=BROADCAST_LINES).select("node", "key", "n", "low", "c"), "crowded-bands")
    discard(open_)
    return crowd


def deduplicate_lines(docs: DataFrame, id_column: str = "doc_id", text: str = "text",
                      percent: int = PERCENT, keep: tuple[str, ...] = ()) -> DataFrame:
    """Documents without the lines that repeat, nearly or exactly, an earlier line of any document.

    Returns per input row: doc_id, text (the lines that stay, in order), n_lines and n_removed (lines that are
    not blank; removed ones), and the columns of ``keep``. Earlier means a smaller id, then a smaller place.

    Cases: a null text stays null with no lines; blank lines are no lines and stay; a line shorter than a
    shingle is compared whole; rows that share an id are treated alike, and so are their lines of one place;
    a row with a null id is returned as it is and takes no part; other columns are ignored; an empty table
    gives no rows.
    """
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"), *keep)
    lines = lines_of(source, "doc_id", "text")
    banded = banded_lines(lines)
    tied = similar_lines(lines, percent, banded)
    placed = banded.where("listed").select("doc_id", "place", "node")
    named = attached(placed, tied, "node", "left", limit=BROADCAST_LINES).select(
        "doc_id", "place", F.coalesce("component", "node").alias("component"))
    repeated = stored(named.groupBy("component").agg(
        F.min(F.struct("doc_id", "place")).alias("first"), F.count("*").alias("n")).where("n > 1")
        .select("component", "first"), "repeated")
    removed = (attached(named, repeated, "component", limit=BROADCAST_LINES).where(F.struct("doc_id", "place") != F.col("first"))
               .groupBy("doc_id").agg(F.collect_set("place").alias("gone")))
    every = F.split(F.col("text"), "\n")
    removed = stored(removed, "removed")
    discard(tied, banded, repeated)
    kept = F.array_join(F.filter(every, lambda line, i: ~F.array_contains("gone", i)), "\n")
    filled = F.size(F.filter(every, lambda line: trimmed(line) != ""))
    return source.join(removed.hint("merge"), "doc_id", "left").select(
        "doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(filled).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"), *keep)
