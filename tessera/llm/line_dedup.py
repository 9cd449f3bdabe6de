"""Near-duplicate lines by a segment-partition edit join (after G. Li, D. Deng, J. Wang, J. Feng: Pass-Join, 2011), in DataFrame functions only.

Two lines within edit distance t share, unchanged, one of any t+1 segments into which the shorter is cut, at a place that can have
shifted by a few characters only. Every distinct line is indexed by its t+1 segments under its own length, and probes, for each length up to t shorter,
the substrings that can match (multi-match-aware bounds); pairs that meet are verified by banded bit-parallel edit distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Near-equal lines are within one edit for every EDIT_CHARS characters of the shorter one, and within DISTANCE edits at most.
DISTANCE, EDIT_CHARS = 2, 16
#: Keys (8 bytes each) that are sent to all executors; more are joined by a shuffle.
BROADCAST_KEYS = 500_000


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) of all lines that aren't blank; null doc_ids are the least."""
    return docs.select(F.coalesce("doc_id", F.lit(C.LEAST_LONG)).alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "line")).filter(F.trim("line") != "")


def distinct_lines(docs: DataFrame) -> DataFrame:
    """(h1, h2, doc_id, line_no, line): every distinct line at its first occurrence, by doc_id and place."""
    return (
        _lines(docs)
        .groupBy(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"))
        .agg(F.min(F.struct("doc_id", "line_no")).alias("at"), F.first("line").alias("line"))
        .select("h1", "h2", "at.doc_id", "at.line_no", "line")
    )


def _segment(length: Column, i: Column, t: int) -> tuple[Column, Column]:
    """Start (from 1) and length of segment i (from 0) of t+1 that cut a line of the given length evenly, the longer ones last."""
    rest = F.pmod(length, F.lit(t + 1))
    short = ((length - rest) / (t + 1)).cast("int")
    longer_before = F.greatest(F.lit(0), i + rest - (t + 1))
    return i * short + longer_before + 1, short + F.when(i + rest >= t + 1, 1).otherwise(0)


def _keyed(lines: DataFrame, places: list[tuple[int, int, int]], t: int, name: str) -> DataFrame:
    """(name, key): h1 of lines (h1, line, n) and, for each place (d, i, shift), the key of segment i of a line shorter by d characters, shifted; none where a short line has no such place.

    Places are exploded before keys are computed, which keeps the compiled code small.
    """
    d, i, shift = (F.col(f"p.{x}") for x in ("d", "i", "shift"))
    all_places = F.array(*[F.struct(*[F.lit(v).alias(x) for x, v in zip(("d", "i", "shift"), p, strict=True)]) for p in places])
    start, size = _segment(F.col("n") - d, i, t)
    at = start + shift
    inside = (at >= 1) & (at + size - 1 <= F.col("n")) & (size > 0)
    key = F.xxhash64(F.col("n") - d, i, F.substring(F.col("line"), at, size))
    return lines.select("h1", "line", "n", F.explode(all_places).alias("p")).filter(inside).select(F.col("h1").alias(name), key.alias("key"))


def _index(lines: DataFrame, t: int) -> DataFrame:
    """(x, key): the segments of each line under its own length."""
    return _keyed(lines, [(0, i, 0) for i in range(t + 1)], t, "x")


def _probes(lines: DataFrame, t: int) -> DataFrame:
    """(y, key): the substrings of each line that can be segment i of a line shorter by d characters, for d from 0 to t.

    With i segments before and t-i after it, an alignment shifts the segment by at most i to either side as seen from the left, and by at most t-i as seen
    from the right, where the line has d characters more.
    """
    places = [(d, i, shift) for d in range(t + 1) for i in range(t + 1) for shift in range(max(-i, d - (t - i)), min(i, d + (t - i)) + 1)]
    return _keyed(lines, places, t, "y")


def _common(a: Column, b: Column, most: Column, suffix: bool) -> Column:
    """Length of the longest common prefix or suffix, `most` at most, by binary search."""
    cut = (lambda s, n: F.right(s, n)) if suffix else (lambda s, n: F.left(s, n))
    start = F.struct(F.lit(0).alias("lo"), most.cast("int").alias("hi"))

    def step(s, _):
        mid = F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int")
        same = cut(a, mid) == cut(b, mid)
        return F.when(s["lo"] >= s["hi"], s).when(same, F.struct(mid.alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), (mid - 1).alias("hi")))

    return F.aggregate(F.sequence(F.lit(0), F.floor(F.log2(most + 1)).cast("int")), start, step)["lo"]


def edits(a: Column, b: Column, t: int) -> Column:
    """The edit distance of two arrays of characters if it is t or less, else t + 1.

    For e = 0 .. t a bit set holds the diagonals -t .. t that a prefix of `a` reaches with e edits or fewer; one character of `a` moves all diagonals
    at once: a match or a substitution stays, a deletion goes to the diagonal below, an insertion to the one above (bands of the automaton of S. Wu and U. Manber).
    """
    width, mask = 2 * t + 1, (1 << (2 * t + 1)) - 1
    start = F.struct(*[F.lit(sum(1 << (t + d) for d in range(e + 1))).alias(f"r{e}") for e in range(t + 1)])

    def bit(i, d):
        at = i + d
        return F.when((at >= 1) & (at <= F.size(b)) & (F.get(b, at - 1) == F.get(a, i - 1)), 1 << (t + d)).otherwise(0)

    def step(s, i):
        match = sum((bit(i, d) for d in range(-t + 1, t + 1)), bit(i, -t))
        new = []
        for e in range(t + 1):
            r = s[f"r{e}"].bitwiseAND(match)
            if e:
                old = s[f"r{e - 1}"]
                r = r.bitwiseOR(old).bitwiseOR(F.shiftright(old, 1)).bitwiseOR(F.shiftleft(new[-1], 1))
            new.append(r.bitwiseAND(F.lit(mask)))
        return F.struct(*[r.alias(f"r{e}") for e, r in enumerate(new)])

    end = F.aggregate(F.when(F.size(a) > 0, F.sequence(F.lit(1), F.size(a))).otherwise(F.array().cast("array<int>")), start, step)
    diagonal = F.size(b) - F.size(a) + t
    place = F.when((diagonal >= 0) & (diagonal < width), diagonal).otherwise(0)

    def least(s):
        out = F.lit(t + 1)
        for e in range(t, -1, -1):
            out = F.when(F.getbit(s[f"r{e}"].cast("long"), place) == 1, e).otherwise(out)
        return out

    found = F.transform(F.array(end), least)[0]  # the bit sets are computed once
    return F.when((diagonal >= 0) & (diagonal < width), found).otherwise(t + 1)


def _signature(characters: Column) -> Column:
    """Parities of the numbers of hashed characters (c, 64 bits) and of hashed pairs of neighbours (p and q, 128 bits); the ends have an empty neighbour.

    An edit takes away at most one character and brings one, and so at most two pairs and two: lines within t edits differ in
    2t bits of c at most, and in 4t bits of p and q together.
    """
    zero = F.lit(0).cast("long")
    start = F.struct(F.lit("").alias("last"), zero.alias("c"), zero.alias("p"), zero.alias("q"))
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int"))

    def step(s, x):
        pair = F.xxhash64(s["last"], x)
        first = F.getbit(pair, F.lit(40)) == 0
        return F.struct(
            x.alias("last"),
            F.when(x == "", s["c"]).otherwise(s["c"].bitwiseXOR(bit(F.xxhash64(x)))).alias("c"),
            F.when(first, s["p"].bitwiseXOR(bit(pair))).otherwise(s["p"]).alias("p"),
            F.when(first, s["q"]).otherwise(s["q"].bitwiseXOR(bit(pair))).alias("q"),
        )

    return F.aggregate(F.concat(characters, F.array(F.lit(""))), start, step)


def _verified(pairs: DataFrame, texts: DataFrame, t: int, edit_chars: int) -> DataFrame:
    """(h1, h2, x, y): the later lines of the pairs (x, y, the later one is y) of hashes h1 that are near."""
    both = pairs.join(texts.select("h1", "line", "n").toDF("x", "a", "na"), "x").join(texts.select("h1", "h2", "line", "n").toDF("y", "h2", "b", "nb"), "y").filter(F.abs(F.col("na") - F.col("nb")) <= t)
    shorter = F.least("na", "nb")
    both = both.withColumn("p", _common(F.col("a"), F.col("b"), shorter, False))
    both = both.withColumn("q", _common(F.col("a"), F.col("b"), shorter - F.col("p"), True))
    middle = lambda s, n: F.split(F.substring(F.col(s), F.col("p") + 1, F.col(n) - F.col("p") - F.col("q")), "")
    both = both.withColumn("ca", F.filter(middle("a", "na"), lambda c: c != "")).withColumn("cb", F.filter(middle("b", "nb"), lambda c: c != ""))
    allowed = F.least(F.lit(t), F.floor(shorter / edit_chars).cast("int"))
    both = C.materialize(both.select("y", "h2", allowed.alias("allowed"), "ca", "cb"), "line-middles", False)  # else the filter would be computed with its inputs repeated
    return both.filter(edits(F.col("ca"), F.col("cb"), t) <= F.col("allowed")).select(F.col("y").alias("h1"), "h2").distinct()


def near_lines(lines: DataFrame, t: int = DISTANCE, edit_chars: int = EDIT_CHARS) -> DataFrame:
    """(h1, h2) of the distinct lines (h1, h2, doc_id, line_no, line) that are near to an earlier one (by doc_id, line_no).

    First only the keys are found under which different lines meet. The lines of those get a signature that all links respect. Every line is verified against the
    earliest ones under its keys whose signature is near enough; only lines for which that finds nothing are paired with the others, so a template with
    thousands of variants makes few pairs for each.
    """
    long = lines.withColumn("n", F.char_length("line")).filter(F.col("n") >= edit_chars)
    index, probe = _index(long, t), _probes(long, t)
    ranges = index.groupBy("key").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    asking = C.materialize(probe.join(ranges, "key").filter("lo <> y or hi <> y").select("key", "y"), "line-probes")
    keys = C.materialize(asking.select("key").distinct(), "line-keys", False)
    few = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    asked = C.materialize(index.join(few, "key").select("key", "x"), "line-index")
    ids = asked.select(F.col("x").alias("h1")).unionByName(asking.select(F.col("y").alias("h1"))).distinct()
    texts = C.materialize(long.join(ids, "h1").select("h1", "h2", "doc_id", "line_no", "line", "n"), "line-texts")
    signed = C.materialize(texts.select("h1", F.struct("doc_id", "line_no").alias("at"), _signature(F.filter(F.split("line", ""), lambda c: c != "")).alias("sig")).groupBy("h1").agg(F.min("at").alias("at"), F.min_by("sig", "at").alias("sig")), "line-signatures", False)
    left = C.materialize(asked.join(signed.toDF("x", "ax", "sx"), "x"), "line-left", False)
    right = C.materialize(asking.join(signed.toDF("y", "ay", "sy"), "y"), "line-right", False)
    near = f"x <> y and bit_count(sx.c ^ sy.c) <= {2 * t} and bit_count(sx.p ^ sy.p) + bit_count(sx.q ^ sy.q) <= {4 * t}"
    ordered = lambda df: df.select(F.when(F.expr("ax < ay"), F.col("x")).otherwise(F.col("y")).alias("x"), F.when(F.expr("ax < ay"), F.col("y")).otherwise(F.col("x")).alias("y")).distinct()

    first = lambda df, *c: C.materialize(df.groupBy("key").agg(F.min(F.struct(c[1], c[0], c[2])).alias("m")).select("key", "m.*"), "line-heads", False)
    heads = ordered(right.join(first(left, "x", "ax", "sx"), "key").filter(near)).unionByName(ordered(left.join(first(right, "y", "ay", "sy"), "key").filter(near)))
    tried = C.materialize(heads.distinct(), "line-pairs", False)
    found = C.materialize(_verified(tried, texts, t, edit_chars), "line-found", False)

    done = found.select("h1").distinct().withColumn("done", F.lit(True))
    left = C.materialize(left.join(done.toDF("x", "dx"), "x", "left"), "line-left", False)
    right = C.materialize(right.join(done.toDF("y", "dy"), "y", "left"), "line-right", False)
    met = ordered(left.alias("l").join(right.alias("r"), F.expr(f"l.key = r.key and {near} and if(ax < ay, dy, dx) is null")))
    met = C.materialize(met.join(tried, ["x", "y"], "left_anti"), "line-pairs", False)
    return found.unionByName(_verified(met, texts, t, edit_chars)).distinct()


def kept_lines(docs: DataFrame, t: int = DISTANCE, edit_chars: int = EDIT_CHARS) -> DataFrame:
    """(id, kept, n_near): for each doc_id (null: the least), which no two rows may share, the numbers of the lines that stay, blank ones aside, and how many only a near line removes."""
    mark = C.written()
    lines = C.materialize(distinct_lines(docs), "lines")
    near = C.materialize(near_lines(lines, t, edit_chars), "near-lines")
    marked = lines.select("h1", "h2", "doc_id", "line_no").join(near.withColumn("near", F.lit(True)), ["h1", "h2"], "left")
    kept = marked.groupBy("doc_id").agg(F.collect_list(F.when(F.col("near").isNull(), F.col("line_no"))).alias("kept"), F.count("near").alias("n_near"))
    out = C.materialize(kept.withColumnRenamed("doc_id", "id"), "kept-lines")
    C.discard_since(docs.sparkSession, mark, out)
    return out


def rewrite_lines(docs: DataFrame, found: str, t: int = DISTANCE, edit_chars: int = EDIT_CHARS) -> DataFrame:
    """docs and a struct of the name `found`, which docs doesn't have: n_lines, n_removed, n_near and kept_text (null for a null text); see dedup_lines()."""
    key = C.free_name(docs, "row_key")
    keyed = C.row_keys(docs, key)
    kept = kept_lines(keyed.select(F.col(key).alias("doc_id"), "text"), t, edit_chars).select(F.col("id").alias(key), F.struct("kept", "n_near").alias(found))
    rows = keyed.join(kept, key, "left")
    every = F.coalesce(F.split("text", "\n"), F.array().cast("array<string>"))
    rows = rows.withColumn(found, F.struct(every.alias("every"), F.coalesce(F.col(f"{found}.kept"), F.array().cast("array<int>")).alias("stay"), F.col(f"{found}.n_near").alias("n_near"), F.col("text").isNotNull().alias("some")))
    lines = F.col(f"{found}.every")
    blank = F.filter(F.transform(lines, lambda x, i: F.when(F.trim(x) == "", i)), lambda i: i.isNotNull())
    rows = rows.withColumn(found, F.struct(lines.alias("every"), F.sort_array(F.concat(f"{found}.stay", blank)).alias("left"), (F.size(lines) - F.size(blank)).cast("long").alias("n_lines"), F.col(f"{found}.n_near").alias("n_near"), F.col(f"{found}.some").alias("some")))
    text = F.array_join(F.transform(f"{found}.left", lambda i: F.get(F.col(f"{found}.every"), i)), "\n")
    result = F.struct(F.col(f"{found}.n_lines").alias("n_lines"), (F.size(f"{found}.every") - F.size(f"{found}.left")).cast("long").alias("n_removed"), F.coalesce(F.col(f"{found}.n_near"), F.lit(0)).alias("n_near"), F.when(F.col(f"{found}.some"), text).alias("kept_text"))
    return rows.select(*docs.columns, result.alias(found))


def dedup_lines(docs: DataFrame, t: int = DISTANCE, edit_chars: int = EDIT_CHARS) -> DataFrame:
    """Keeps of every line its first occurrence (by doc_id, text, then place), unless a near line occurs first before that.

    Lines are near within one edit for every edit_chars characters of the shorter one, but t at most; so shorter lines than that only equal others. Blank lines are neither counted nor
    removed. Judged on the input: a line that is removed still removes others. Returns one row per row of docs: doc_id, n_lines, n_removed, n_near (of these, first occurrences that only a near line
    removes), kept_text (the lines that stay, joined by newlines; a null text stays null). Rows that share a doc_id, or have none, come
    in the order of their texts, each with lines of its own, so all but the first of equal rows lose their lines; other columns are ignored.
    """
    return rewrite_lines(docs.select("doc_id", "text"), "lines", t, edit_chars).select("doc_id", "lines.*")
