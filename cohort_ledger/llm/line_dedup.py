"""Line dedup by a segment-partition edit join.

Two lines within ``edits`` edits of each other, cut one of them into
``edits + 1`` segments: one segment is left whole, so it occurs in the other
line, moved by no more than the edits on its either side.  Each line of
``LEAST_CHARS`` characters or more is indexed by its segments under its own
length, and probes the index of every length up to ``edits`` shorter at the few
places a whole segment can stand.  Pairs that meet are verified by a banded
bit-parallel edit distance.

A segment that very many lines share would make pairs of all of them.  Such a
key is not paired: the segment is taken out of its lines, and what is left is
cut and probed again under that key, until the groups are small.  No pair is
lost, for what is left is still within ``edits`` edits.  A group whose rest is
too short to cut holds similar lines only.

Only built-in functions are used.  Equal lines are one node, known by a 64-bit
hash.  Order is (doc_id, line number): a line is removed if an equal line
stands earlier, or if its text is within ``edits`` of one that first stands
earlier.

Defined results: a NULL text has no lines; lines without a visible character
are never removed; shorter lines are removed only if equal; rows with equal
doc_id are one document, and repeated rows count their lines as often as they
come; a NULL doc_id sorts first; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohort_ledger.session import cut

EDITS = 2
LEAST_CHARS = 16
HOT = 8  #: a key is paired if its pairs are at most this many times its members


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, n, node) of every line; a document without text has one row of NULLs.

    Length ``n`` and ``node`` are made before the lines are listed, so that
    they are worked out once however often they are used.
    """
    node = lambda x: F.when(x.rlike(r"[^\x00-\x20]"), F.xxhash64(x))
    each = F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("line"), F.length(x).alias("n"), node(x).alias("node")))
    return docs.select("doc_id", F.posexplode_outer(each).alias("line_no", "l")).select("doc_id", "line_no", "l.line", "l.n", "l.node")


def _segment(length: Column, parts: int, i: int) -> tuple[Column, Column]:
    """Start (from 1) and length of segment i (from 0) of a line; later segments take the remainder."""
    base, spare = F.floor(length / parts).cast("int"), (length % parts).cast("int")
    longer = F.greatest(F.lit(0), F.lit(i - parts) + spare)
    return 1 + base * i + longer, base + F.when(spare >= parts - i, 1).otherwise(0)


def _places(edits: int, shift: int) -> list[tuple[int, int]]:
    """(segment, offset) at which a whole segment of a line ``shift`` shorter can stand."""
    return [
        (i, off)
        for i in range(edits + 1)
        for off in range(max(-i, shift - (edits - i)), min(i, shift + (edits - i)) + 1)
    ]


def _spots(edits: int, shifts: range, probe: bool) -> list[tuple[int, int, int]]:
    """(segment, offset, shift) of each key of a line, as probe or as index."""
    return [(i, off, s) for s in shifts for i, off in (_places(edits, s) if probe else [(i, 0) for i in range(edits + 1)])]


def _place(length: Column, spot: tuple[int, int, int], edits: int) -> tuple[Column, Column]:
    """Where a key's segment starts in a line, and its size."""
    i, off, shift = spot
    start, size = _segment(length - shift, edits + 1, i)
    return start + off, size


def _key(text: Column, length: Column, spot: tuple[int, int, int], edits: int, *under: Column) -> Column:
    at, size = _place(length, spot, edits)
    return F.xxhash64(*under, F.lit(spot[0]), length - spot[2], text.substr(at, size))


def _keyed(rows: DataFrame, spots: list[tuple[int, int, int]], edits: int, *keep: str) -> DataFrame:
    """(keep, spot, key): a row for each key of (text, n, ...)."""
    under = [F.col("under")] if "under" in rows.columns else []
    keys = [_key(F.col("text"), F.col("n"), s, edits, *under) for s in spots]
    return rows.select(*keep, F.posexplode(F.array(*keys)).alias("spot", "key"))


def _shift(spots: list[tuple[int, int, int]]) -> Column:
    return F.get(F.array(*[F.lit(s[2]) for s in spots]), F.col("spot"))


def _placed(rows: DataFrame, spots: list[tuple[int, int, int]], edits: int) -> DataFrame:
    """Rows of (n, spot, ...) with ``at``, ``size`` and ``shift`` of their keys."""
    places = [F.struct(*[x.alias(c) for x, c in zip(_place(F.col("n"), s, edits), ("at", "size"))]) for s in spots]
    return rows.withColumn("shift", _shift(spots)).withColumn("p", F.get(F.array(*places), F.col("spot"))).select(*rows.columns, "shift", "p.at", "p.size")


def _met(index: DataFrame, probes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Index rows and probe rows whose key is held by two different nodes, one of each kind."""
    held = index.groupBy(F.col("key").alias("held")).agg(F.min("node").alias("low"), F.max("node").alias("high"))
    asked = cut(
        probes.join(held, F.col("key") == F.col("held"))
        .where("low <> node OR high <> node")
        .drop("held", "low", "high")
        .distinct()
    )
    wanted = asked.select(F.col("key").alias("held")).distinct()
    return cut(index.join(wanted, F.col("key") == F.col("held"), "left_semi").distinct()), asked


def _sized(index: DataFrame, probes: DataFrame) -> DataFrame:
    """(sized, hot) for each key: would its pairs be too many for its members?"""
    n_index = index.groupBy("key").agg(F.count(F.lit(1)).alias("n_index"))
    n_probe = probes.groupBy(F.col("key").alias("sized")).agg(F.count(F.lit(1)).alias("n_probe"))
    both = n_index.join(n_probe, F.col("key") == F.col("sized"))
    return both.select("sized", (F.col("n_index") * F.col("n_probe") > HOT * (F.col("n_index") + F.col("n_probe"))).alias("hot"))


def _paired(index: DataFrame, probes: DataFrame) -> DataFrame:
    left = probes.select("key", F.col("node").alias("x"))
    pairs = left.join(index.select("key", "node"), "key").where("x <> node")
    return pairs.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()


def _without(text: str, at: str, size: str) -> Column:
    return F.concat(F.expr(f"substring({text}, 1, {at} - 1)"), F.expr(f"substring({text}, {at} + {size})"))


def candidates(all_lines: DataFrame, edits: int = EDITS, least: int = LEAST_CHARS) -> tuple[DataFrame, DataFrame]:
    """Pairs (a < b) of nodes that share a segment, and the texts (node, text) of nodes in question."""
    long = all_lines.where(F.col("node").isNotNull() & (F.col("n") >= least)).select("node", F.col("line").alias("text"), "n")
    own, asked = _spots(edits, range(1), False), _spots(edits, range(edits + 1), True)
    index = _keyed(long, own, edits, "node", "n")
    probes = _keyed(long, asked, edits, "node", "n").where(F.col("n") - _shift(asked) >= least)

    index, probes = _met(index, probes)
    concerned = index.select(F.col("node").alias("wanted")).union(probes.select("node")).distinct()
    texts = cut(long.join(concerned, F.col("node") == F.col("wanted"), "left_semi").groupBy("node").agg(F.first("text").alias("text")))
    held = texts.select(F.col("node").alias("owner"), "text")
    found, first = [], True
    while True:
        sized = cut(_sized(index, probes))
        calm, hot = (sized.where(F.col("hot") == x).select("sized") for x in (False, True))
        if not first:  # a rest too short to cut is paired as it is
            short = index.where(F.length("text") <= edits).select(F.col("key").alias("sized")).distinct()
            calm, hot = calm.union(short).distinct(), hot.join(short, "sized", "left_anti")
        among = lambda rows, keys: rows.join(keys, F.col("key") == F.col("sized"), "left_semi")
        found.append(_paired(among(index, calm), among(probes, calm)))
        index, probes = among(index, hot), among(probes, hot)
        index, probes = _placed(index, own, edits), _placed(probes, asked, edits)
        if first:
            index, probes = (x.join(held, F.col("node") == F.col("owner")).drop("owner") for x in (index, probes))
            first = False
        rest = _without("text", "at", "size")
        index = cut(index.select("node", F.col("key").alias("under"), rest.alias("text")).distinct())
        if index.isEmpty():
            break
        probes = probes.select("node", F.col("key").alias("under"), "shift", rest.alias("text")).distinct()
        index, probes = (x.withColumn("n", F.length("text")) for x in (index, probes))
        # A line stays as much longer than its partner as it was.
        by_shift = probes.withColumnRenamed("shift", "gap")
        index = _keyed(index, own, edits, "node", "text", "n")
        probes = _keyed(by_shift, asked, edits, "node", "text", "n", "gap").where(F.col("gap") == _shift(asked)).drop("gap")
        index, probes = _met(index, probes)
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    return pairs.distinct(), texts


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, wherever the optimizer moves it."""
    return F.transform(F.array(value), use)[0]


def _common(a: Column, b: Column, most: Column, start) -> Column:
    """Length of the common run of two texts, ``most`` at most, by halving steps.

    ``start`` gives the place of the next ``step`` characters behind ``have``.
    """
    highest = F.floor(F.log2(most + 1)).cast("int")
    steps = F.transform(F.sequence(highest, F.lit(0), F.lit(-1)), lambda e: F.call_function("shiftleft", F.lit(1), e))
    same = lambda have, step: F.substring(a, start(a, have, step), step) == F.substring(b, start(b, have, step), step)
    return F.aggregate(steps, F.lit(0), lambda have, step: F.when((have + step <= most) & same(have, step), have + step).otherwise(have))


def _characters(text: Column, start: Column, size: Column) -> Column:
    return F.regexp_extract_all(F.substring(text, start, size), F.lit("(?s)."), F.lit(0))


def _distance(longer: Column, shorter: Column, gap: Column, k: int) -> Column:
    """Edit distance of two arrays of characters, right up to ``k`` and larger beyond."""
    width, mask = 2 * k + 1, (1 << (2 * k + 1)) - 1
    cover = lambda x: x.bitwiseAND(F.lit(mask))

    def equal_at(x):
        bits = [F.when(F.get(longer, x["j"] + (b - k)) == x["c"], 1 << b).otherwise(0) for b in range(width)]
        whole = bits[0]
        for bit in bits[1:]:
            whole = whole.bitwiseOR(bit)
        return whole

    def moved(s, x):
        vp, vn = s["vp"], s["vn"]
        diagonal = lambda m: cover(((m.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(m).bitwiseOR(vn))
        across = lambda d: F.struct(d.alias("d"), cover(vn.bitwiseOR(F.bitwise_not(d.bitwiseOR(vp)))).alias("p"), d.bitwiseAND(vp).alias("n"))
        down = lambda h: F.struct(
            cover(h["n"].bitwiseOR(F.bitwise_not(F.shiftright(h["d"], 1).bitwiseOR(h["p"])))).alias("vp"),
            F.shiftright(h["d"], 1).bitwiseAND(h["p"]).alias("vn"),
            (s["score"] + 1 - F.shiftright(h["d"], 2 * k)).alias("score"),
        )
        return _let(_let(_let(equal_at(x), diagonal), across), down)

    def settled(s):
        above = F.call_function("shiftleft", F.lit(1), F.lit(k) - gap) - 1
        rise = lambda v: F.bit_count(F.call_function("shiftright", v, gap + k).bitwiseAND(above))
        return s["score"] - rise(s["vp"]) + rise(s["vn"])

    start = F.struct(F.lit(((1 << (k + 1)) - 1) << k).alias("vp"), F.lit(0).alias("vn"), F.lit(k).alias("score"))
    text = F.transform(shorter, lambda c, j: F.struct(c.alias("c"), j.alias("j")))
    return F.aggregate(text, start, lambda s, x: F.when(s["score"] > 2 * k - gap, s).otherwise(moved(s, x)), settled)


def within(rows: DataFrame, edits: int = EDITS) -> DataFrame:
    """The rows of (..., longer, shorter) at most ``edits`` edits apart, with their ``distance``.

    Common ends are cut off.  A column of the distance matrix is kept as two
    words of ``2 * edits + 1`` bits, the rises and falls down a band around the
    diagonal, and moved on by a character of the shorter text at a time.
    ``score`` follows the band's lower edge; once it is beyond ``edits`` and all
    that the band above could win back, the pair is given up.
    """

    def measured(t):
        a, b = t["longer"], t["shorter"]
        head = _common(a, b, F.length(b), lambda x, have, step: have + 1)
        tail = lambda h: _common(a, b, F.length(b) - h, lambda x, have, step: F.length(x) - have - step + 1)
        middle = lambda e: F.struct(
            _characters(a, e["head"] + 1, F.length(a) - e["head"] - e["tail"]).alias("longer"),
            _characters(b, e["head"] + 1, F.length(b) - e["head"] - e["tail"]).alias("shorter"),
        )
        ends = _let(head, lambda h: F.struct(h.alias("head"), tail(h).alias("tail")))
        gap = F.length(a) - F.length(b)
        return _let(_let(ends, middle), lambda m: F.when(F.size(m["shorter"]) == 0, gap).otherwise(_distance(m["longer"], m["shorter"], gap, edits)))

    near = rows.where(F.length("longer") - F.length("shorter") <= edits)
    return near.withColumn("distance", _let(F.struct("longer", "shorter"), measured)).where(F.col("distance") <= edits)


def links(all_lines: DataFrame, edits: int = EDITS, least: int = LEAST_CHARS) -> DataFrame:
    """Pairs (a < b) of nodes whose lines are within ``edits`` edits."""
    pairs, texts = candidates(all_lines, edits, least)
    a, b = (texts.select(F.col("node").alias(f"n{c}"), F.col("text").alias(f"t{c}")) for c in "ab")
    both = pairs.join(a, F.col("a") == F.col("na")).join(b, F.col("b") == F.col("nb"))
    turned = F.length("ta") >= F.length("tb")
    sided = both.select("a", "b", F.when(turned, F.col("ta")).otherwise(F.col("tb")).alias("longer"), F.when(turned, F.col("tb")).otherwise(F.col("ta")).alias("shorter"))
    return within(sided, edits).select("a", "b")


def duplicate_lines(docs: DataFrame, edits: int = EDITS, least: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, n_lines, n_equal, n_near, n_links, removed_lines) of every document.

    ``n_equal`` lines equal an earlier one, ``n_near`` lines are first of their
    text but near an earlier one; both are listed in ``removed_lines`` by
    number from 0.  ``n_links`` counts links of the document's lines to other
    texts.
    """
    all_lines = lines(docs)
    edges = cut(links(all_lines, edits, least))
    places = all_lines.select("doc_id", "line_no", "node")
    firsts = places.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("doc_id", "line_no")).alias("first"))
    ends = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select("b", "a"))
    known = firsts.select(F.col("node").alias("known"), "first")
    # Links of both directions, so a node is the later one where its own first place is later.
    own = ends.join(known, F.col("x") == F.col("known")).select("x", "y", F.col("first").alias("mine"))
    other = own.join(known, F.col("y") == F.col("known")).select("x", (F.col("mine") > F.col("first")).alias("later"))
    linked = other.groupBy("x").agg(F.count(F.lit(1)).alias("degree"), F.max("later").alias("near"))
    status = firsts.join(linked, F.col("node") == F.col("x"), "left").select(F.col("node").alias("of"), "first", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("near", F.lit(False)).alias("near"))
    each = places.join(status, F.col("node") == F.col("of"), "left")
    equal = F.coalesce(F.struct("doc_id", "line_no") != F.col("first"), F.lit(False))
    near = ~equal & F.coalesce("near", F.lit(False))
    return each.groupBy("doc_id").agg(
        F.count("line_no").alias("n_lines"),
        F.count_if(equal).alias("n_equal"),
        F.count_if(near).alias("n_near"),
        F.coalesce(F.sum("degree"), F.lit(0)).alias("n_links"),
        F.sort_array(F.collect_set(F.when(equal | near, F.col("line_no")))).alias("removed_lines"),
    )


def without_duplicates(docs: DataFrame, edits: int = EDITS, least: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, kept_text) of every row: the text without the removed lines."""
    removed = duplicate_lines(docs, edits, least).where("size(removed_lines) > 0").select(F.col("doc_id").alias("cut_id"), "removed_lines")
    rows = docs.select("doc_id", "text").join(removed, F.col("doc_id").eqNullSafe(F.col("cut_id")), "left")
    kept = F.expr("array_join(filter(split(text, '\n'), (l, i) -> NOT array_contains(coalesce(removed_lines, CAST(array() AS array<int>)), i)), '\n')")
    return rows.select("doc_id", kept.alias("kept_text"))
