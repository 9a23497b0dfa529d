"""Line dedup: exact, then within ``max_edits`` by segment partition.  DataFrame functions only.

Lines are compared trimmed and lower-cased; blank ones are left alone.  A line goes
if an equal line comes earlier (by doc_id, then line number), or, from
``min_chars`` characters on, if an earlier first line is within ``max_edits`` edits
of it.  In shorter lines one edit is no small part, so there only equal lines go.

A line of n characters is cut into ``max_edits + 1`` segments.  A line within
``max_edits`` of it that isn't shorter holds one segment unchanged, at one of a
few places that follow from the lengths, so both sides hash (length, segment
number, characters) and meet in an equi-join.  Keys with many lines are split
again: the rest of the line, without the segment, must be within ``max_edits``
too, so it is cut into segments the same way and the key grows by one of them.
Pairs are verified by a banded bit-parallel automaton: one machine word holds the
diagonals of the band, one word for each number of edits.

Defined results: null or empty texts have no line to compare and come back as
they are; rows that share a doc_id count as one document, and equal lines at
equal numbers in them share their fate; a null doc_id sorts first; ids must be
whole numbers; a very long text is cut by the places of its lines, so work grows
with its length; columns of any further name stay; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, fresh, of_ids, small

MAX_EDITS = 1
MIN_CHARS = 20
#: Index lines of a key above which it is split again.
HOT = 50
MAX_LEVELS = 12
#: Repeated lines, four numbers each, that are broadcast: under 16 MB.
FEW_LINES = 250_000
#: The most frequent lines of more, joined by broadcast: at most so many, of more than so many copies each.
FREQUENT, COPIES = 10_000, 200
NULL_ID = -(1 << 63)


def lines_of(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """doc (id), line_no and line (compared form)."""
    text = F.coalesce("text", F.lit(""))
    # Made within the list, as the filter would make each line's compared form a second time.
    lines = F.transform(F.split(text, "\n"), compared)
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.posexplode(lines).alias("line_no", "line")).where(F.length("line") >= min_chars)


def compared(line: Column) -> Column:
    return F.lower(F.btrim(line, F.lit(" \t\r")))


def exact_repeats(docs: DataFrame, scratch: list) -> DataFrame:
    """(doc, line_no, o) of lines with an equal earlier line.  Equal means equal in two 64-bit hashes.

    Up to ``FEW_LINES`` repeated lines meet their copies by broadcast.  Of more, the
    ``FREQUENT`` commonest do, so no task gathers a line's copies; any other line is
    at most that part of all.
    ``scratch`` gets the tables it wrote.
    """
    seen = lines_of(docs).select(F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"), "doc", "line_no")
    seen = cut(seen, "seen")  # the texts are split and hashed once, not for each side of the join
    place = F.struct("doc", "line_no")
    first = cut(seen.groupBy("a", "b").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"), "first")
    scratch += [seen, first]
    again = F.col("first") != place
    if first.count() <= FEW_LINES:
        return seen.join(F.broadcast(first.drop("n")), ["a", "b"]).where(again).select("doc", "line_no", F.col("a").alias("o"))
    common = cut(first.where(F.col("n") > COPIES).orderBy(F.desc("n"), "a", "b").limit(FREQUENT).drop("n"), "common")
    scratch.append(common)
    often = seen.join(F.broadcast(common), ["a", "b"])
    seldom = seen.join(F.broadcast(common), ["a", "b"], "left_anti").join(small(first.join(F.broadcast(common), ["a", "b"], "left_anti").drop("n")), ["a", "b"])
    return often.unionByName(seldom).where(again).select("doc", "line_no", F.col("a").alias("o"))


def without(docs: DataFrame, gone: DataFrame, n_gone: str, scratch: list) -> DataFrame:
    """``docs`` with the named lines taken out of the text, and their number as ``n_gone``.

    The lines between those that go are kept as slices, so a text costs what it is
    long.  The tables in ``scratch``, which ``gone`` came from, are deleted; in it
    comes the one the result needs.
    """
    doc, list_ = fresh(docs, "doc"), fresh(docs, "lines")
    lists = gone.groupBy(F.col("doc").alias(doc)).agg(F.sort_array(F.collect_set(F.struct("line_no", "o"))).alias(list_))
    lists = cut(lists, "lines")
    discard(*scratch)
    scratch[:] = [lists]
    joined = docs.join(small(lists, F.size(list_)), F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)) == F.col(doc), "left")
    here = f"transform(filter(`{list_}`, g -> g.line_no < size(t.lines) AND xxhash64(lower(btrim(t.lines[g.line_no], ' \\t\\r'))) = g.o), g -> g.line_no)"
    gaps = "transform(sequence(0, size(u.at)), j -> slice(u.lines, if(j = 0, 1, u.at[j - 1] + 2), if(j = size(u.at), size(u.lines), u.at[j]) - if(j = 0, 0, u.at[j - 1] + 1)))"
    at = f"transform(array(struct(split(text, '\\n') AS lines)), t -> struct(t.lines AS lines, {here} AS at))"
    made = fresh(docs, "made")
    cut_up = F.when(F.col(list_).isNotNull(), F.expr(f"transform({at}, u -> struct(array_join(flatten({gaps}), '\\n') AS text, size(u.at) AS n))[0]"))
    out = joined.withColumn(made, cut_up)
    text = F.when(F.col(list_).isNull(), F.col("text")).otherwise(F.col(made)["text"])
    n = F.coalesce(F.col(made)["n"], F.lit(0)).cast("long")
    return out.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns], n.alias(n_gone))


def _segments(n: str, edits: int) -> list[tuple[str, str]]:
    """SQL for (start from 0, length) of each of edits + 1 segments of n characters; the last ones are longer by one."""
    k = edits + 1
    short, extra = f"({n} div {k})", f"({n} % {k})"
    return [(f"({i} * {short} + greatest(0, {i} - {k} + {extra}))", f"({short} + if({i} >= {k} - {extra}, 1, 0))") for i in range(k)]


def _key(n: str, i: int, start: str, length: str, rest: bool) -> str:
    key = f"xxhash64(salt, {n}, {i}, substring(line, {start} + 1, {length}))"
    return f"struct({key} AS key, concat(left(line, {start}), substring(line, {start} + {length} + 1)) AS rest)" if rest else key


def index_keys(edits: int, rest: bool = False) -> list[str]:
    return [_key("n", i, s, w, rest) for i, (s, w) in enumerate(_segments("n", edits))]


def probe_keys(edits: int, rest: bool = False, own: bool = True) -> list[str]:
    """Keys under which shorter or equal lines within ``edits`` are found; null where a place lies outside.

    Without ``own``, those are left out that are the line's own index keys.
    """
    out = []
    for delta in range(edits + 1):
        n = f"(n - {delta})"
        for i, (s, w) in enumerate(_segments(n, edits)):
            for shift in range(max(-i, delta - (edits - i)), min(i, delta + edits - i) + 1):
                if not (delta or shift or own):
                    continue
                start = f"({s} + {shift})"
                out.append(f"if({start} >= 0 AND {start} + {w} <= n AND {n} > {edits}, {_key(n, i, start, w, rest)}, NULL)")
    return out


def _array(entries: list[str]) -> str:
    return f"array({', '.join(entries)})"


def candidate_pairs(lines: DataFrame, edits: int, scratch: list, hot: int = HOT, max_levels: int = MAX_LEVELS) -> DataFrame:
    """(p, q) names of lines that share a key, p on the index side; ``lines`` has name, line."""
    at = lines.select("name", "line", F.lit(0).cast("long").alias("salt"), F.length("line").alias("n"), F.lit(True).alias("i"), F.lit(True).alias("p"))
    out = None
    for level in range(max_levels + 1):
        # The texts are walked once; both sides' keys are kept in one narrow table, and a line's index keys serve both.
        on, off = index_keys(edits), probe_keys(edits, own=False)
        if level:  # rows are of one side
            off = [f"if(p, {k}, NULL)" for k in off]
        rest_n = F.expr("CASE pos " + " ".join(f"WHEN {i} THEN n - {w}" for i, (_, w) in enumerate(_segments("n", edits))) + " END")
        keys = at.select("name", "salt", "n", "i", "p", F.posexplode(F.expr(_array(on + off))).alias("pos", "key")).where("key IS NOT NULL")
        sides = (F.col("i") & (F.col("pos") <= edits)).alias("index"), (F.col("p") & (F.col("n") > edits)).alias("probe")
        keys = cut(keys.select("name", "salt", "key", *sides, rest_n.alias("rest_n")), "keys")
        scratch.append(keys)
        index, probe = keys.where("index"), keys.where("probe")
        many = None
        if level < max_levels:
            # A key fixes the length of what is left, and that must still have room for segments.
            sizes = index.groupBy("key").agg(F.count("*").alias("c"), F.min("rest_n").alias("rest_n"))
            many = cut(sizes.where((F.col("c") > hot) & (F.col("rest_n") >= 2 * (edits + 1))).select("key"), "hot")
            scratch.append(many)
            if many.isEmpty():
                many = None
            else:
                many = small(many)
        cool = index if many is None else index.join(many, "key", "left_anti")
        pairs = cool.select(F.col("name").alias("p"), "key").join(probe.select(F.col("name").alias("q"), "key"), "key").where("p <> q").select("p", "q")
        out = pairs if out is None else out.unionAll(pairs)
        if many is None:
            break
        rows = []
        for side, rest in (("i", _array(index_keys(edits, True))), ("p", _array(probe_keys(edits, True)))):
            touched = (index if side == "i" else probe).join(many, "key", "left_semi").select("name", "salt").distinct()
            grown = at.where(side).join(touched, ["name", "salt"], "left_semi").select("name", F.explode(F.expr(rest)).alias("k")).where("k IS NOT NULL")
            grown = grown.select("name", F.col("k.key").alias("key"), F.col("k.rest").alias("line")).join(many, "key", "left_semi")
            rows.append(grown.select("name", "line", F.col("key").alias("salt"), F.length("line").alias("n"), F.lit(side == "i").alias("i"), F.lit(side == "p").alias("p")))
        at = cut(rows[0].unionAll(rows[1]), "split")
        scratch.append(at)
    return out


def within_edits(a: str, b: str, edits: int) -> Column:
    """Whether two columns are within ``edits``: a banded automaton in machine words.

    Bit d + edits of register e: the first i characters of ``a`` are within e
    edits of the first i + d of ``b``.
    """
    k, width = edits, 2 * edits + 1
    full = (1 << width) - 1
    start = ", ".join(f"{sum(1 << (d + k) for d in range(0, e + 1))}L AS r{e}" for e in range(k + 1))
    match = " | ".join(f"if(get(x.b, i + {d}) = x.a[i], {1 << (d + k)}L, 0L)" for d in range(-k, k + 1))
    step = "named_struct('r0', s.r0 & m)"
    steps = ["s.r0 & m"]
    for e in range(1, k + 1):
        steps.append(f"((s.r{e} & m) | s.r{e - 1} | shiftright(s.r{e - 1}, 1) | (shiftleft(({steps[-1]}), 1) & {full}L))")
    step = "named_struct(" + ", ".join(f"'r{e}', {x}" for e, x in enumerate(steps)) + ")"
    walk = f"aggregate(sequence(0, size(x.a) - 1), named_struct({', '.join(f"'r{e}', {sum(1 << (d + k) for d in range(0, e + 1))}L" for e in range(k + 1))}), (s, i) -> transform(array({match}), m -> {step})[0], s -> s.r{k})"
    test = f"(shiftright({walk}, size(x.b) - size(x.a) + {k}) & 1L) = 1L"
    return F.expr(f"abs(length({a}) - length({b})) <= {k} AND transform(array(struct(split({a}, '') AS a, split({b}, '') AS b)), x -> {test})[0]")


def near_repeats(docs: DataFrame, scratch: list, edits: int = MAX_EDITS, min_chars: int = MIN_CHARS, hot: int = HOT) -> DataFrame:
    """(doc, line_no, o) of lines within ``edits`` of an earlier line, where ``docs`` has no equal lines left."""
    lines = lines_of(docs, max(min_chars, edits + 1)).select(F.struct("doc", "line_no").alias("name"), "line", "doc", "line_no")
    pairs = cut(candidate_pairs(lines.select("name", "line"), edits, scratch, hot).distinct(), "pairs")
    discard(*scratch)
    hit = cut(pairs.select(F.col("p.doc").alias("doc")).unionAll(pairs.select("q.doc")).distinct(), "hit")
    scratch[:] = [pairs, hit]
    texts = of_ids(lines, "doc", hit)
    p, q = (texts.select(F.col("name").alias(x), F.col("line").alias(f"{x}_line")) for x in "pq")
    both = pairs.join(p, "p").join(q, "q").where(within_edits("p_line", "q_line", edits))
    later = both.select(F.when(F.col("p") > F.col("q"), F.struct("p", F.col("p_line").alias("line"))).otherwise(F.struct(F.col("q").alias("p"), F.col("q_line").alias("line"))).alias("x"))
    return later.select(F.col("x.p.doc").alias("doc"), F.col("x.p.line_no").alias("line_no"), F.xxhash64("x.line").alias("o")).distinct()


def dedup_lines(docs: DataFrame, edits: int = MAX_EDITS, min_chars: int = MIN_CHARS, hot: int = HOT, counts: bool = True) -> DataFrame:
    """All columns of ``docs``, repeated lines taken out of ``text``; with ``counts``, n_exact and n_near, the numbers of lines taken out.

    With ``counts``, columns of these names (in any case) are replaced.
    """
    if counts:
        docs = docs.drop("n_exact", "n_near")
    n_exact, n_near = fresh(docs, "n_exact"), fresh(docs, "n_near")
    scratch: list = []
    once = cut(without(docs, exact_repeats(docs, scratch), n_exact, scratch), "once")
    discard(*scratch)
    scratch.clear()
    out = without(once, near_repeats(once, scratch, edits, min_chars, hot), n_near, scratch)
    added = [F.col(n_exact).alias("n_exact"), F.col(n_near).alias("n_near")] if counts else []
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *added)
