"""Line dedup by winnowing over line hashes, in DataFrame and SQL functions only.

A line counts if it is not blank once trimmed of spaces. From every window of ``window`` counting lines the smallest hash is kept
as a fingerprint (the last of equal ones), so a repeated run of at least ``window`` lines shares a fingerprint with its other copies. Fingerprints
that occur twice or more are joined by position; each is extended both ways in windows that contain it; a window
equal to one that begins earlier, in the order of doc_id, then place in the text, is a later copy. The union of such windows is the
later run, and its lines are deleted. Every repeated run loses all but its first copy.

A line of ``long_words`` or more words is a run by itself: its later copies are deleted whatever stands beside them, in texts of one or two lines too.
With ``long_words=None`` only runs of ``window`` lines count. The first copy of a line is in no window equal to an earlier one, so it always stays.

Only fingerprints are shuffled, not lines. First positions come from a pre-aggregated minimum, so a very common line is one row for each task,
and joins back to it are of stored tables, which Spark can split. Work on one text is in proportion to its length: arrays that are read
by place are bound once (``_let``), and a fingerprint carries only the hashes of the lines around it.

Null and empty texts have no lines and stay as they are. Rows with equal doc_id and equal text are one document: all or none lose a run. Null doc_ids
come first. Blank lines stay. A text that loses all its lines becomes empty; its row stays. Other columns pass through whatever
their names; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._runtime import Workspace

WINDOW, LONG_WORDS = 3, 50


def fresh(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _let(value: Column, body) -> Column:
    """body(value), where value is computed once however often body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _long(line: Column, words: int | None) -> Column:
    """Whether a line has as many words. The pattern never goes back and reads no further than those words; shorter lines than can hold them are not searched."""
    gap, word = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
    return F.lit(False) if words is None else (F.length(line) >= 2 * words - 1) & F.rlike(line, F.lit(rf"^{gap}*+(?:{word}++{gap}++){{{words - 1}}}{word}"))


def _counting(lines: Column, long_words: int | None = None) -> Column:
    """(place, hash, second hash, blank, long) of each line that is not blank."""
    each = F.transform(lines, lambda x, i: F.struct(i.alias("at"), F.xxhash64(F.trim(x)).alias("h"), F.xxhash64(F.lit("second"), F.trim(x)).alias("g"), (F.trim(x) == "").alias("blank"), _long(x, long_words).alias("long")))
    return F.filter(each, lambda e: ~e["blank"])


def _fingerprints(a: Column, window: int, long_words: int | None) -> Column:
    """(fp, grams) for each fingerprint of the counting lines ``a``; grams: (s, n, g1, g2) of every run of n lines that holds it."""
    size = F.size(a)
    least = lambda j: F.array_min(F.transform(F.slice(a, j, window), lambda e, k: F.struct(e["h"].alias("h"), (-(j + k)).alias("i"))))
    minima = F.when(size >= window, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), size - window + 1)), least))
    # minima stand in the order of their places, so equal ones follow one another
    new = _let(F.coalesce(minima, F.array().cast("array<struct<h: bigint, i: int>>")), lambda m: F.filter(m, lambda e, k: (k == 0) | (F.get(m, k - 1)["i"] != e["i"])))

    def found(fp: Column, at: Column, n: int) -> Column:
        run = lambda s: F.slice(a, s + 1, n)
        gram = lambda s: F.struct(s.alias("s"), F.lit(n).alias("n"), F.xxhash64(F.transform(run(s), lambda e: e["h"])).alias("g1"), F.xxhash64(F.transform(run(s), lambda e: e["g"])).alias("g2"))
        return F.struct(fp.alias("fp"), F.transform(F.sequence(F.greatest(F.lit(0), at - n + 1), F.least(at, size - n)), gram).alias("grams"))

    out = F.transform(new, lambda f: found(f["h"], -f["i"] - 1, window))
    if long_words is None or window == 1:
        return out
    # those of long lines are hashed once more, so that they meet only each other
    each = F.filter(F.transform(a, lambda e, i: F.struct(e["h"].alias("h"), i.alias("at"), e["long"].alias("long"))), lambda e: e["long"])
    return F.concat(out, F.transform(each, lambda e: found(F.xxhash64(e["h"], F.lit(1)), e["at"], 1)))


def later_runs(ws: Workspace, docs: DataFrame, id_col: str, text_col: str, window: int, long_words: int | None = None) -> DataFrame:
    """(id, key, starts): for each document that holds later copies, (s, n): where they begin, counted in lines that are not blank, and their number of lines."""
    found = _let(_counting(_split(F.col(text_col)), long_words), lambda a: _fingerprints(a, window, long_words))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), found.alias("found"))
    anchors = ws.put(rows.select("id", "key", F.inline("found")), "anchors")
    common = ws.put(anchors.groupBy("fp").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("fp"), "common")
    found = ws.put(anchors.join(common.hint("merge"), "fp").select("id", "key", F.inline("grams")), "windows")
    first = ws.put(found.groupBy("n", "g1", "g2").agg(F.min(F.struct("id", "key", "s")).alias("first")), "first")
    later = found.join(first.hint("merge"), ["n", "g1", "g2"]).where(F.struct("id", "key", "s") != F.col("first")).groupBy("id", "key").agg(F.collect_set(F.struct("s", "n")).alias("starts"))
    out = ws.put(later, "later")
    ws.drop(anchors, common, found, first)
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, counts: bool = False, long_words: int | None = LONG_WORDS) -> DataFrame:
    """``docs`` without later copies of runs of ``window`` or more lines and of lines of ``long_words`` or more words; ``counts`` adds n_lines and n_removed."""
    ws = Workspace(docs.sparkSession, "lines")
    own, key, starts = fresh(docs, "line_id"), fresh(docs, "line_key"), fresh(docs, "line_starts")
    later = later_runs(ws, docs, id_col, text_col, window, long_words).select(F.col("id").alias(own), F.col("key").alias(key), F.col("starts").alias(starts))
    # equal hashes of different documents do not meet: the id is compared too
    joined = docs.alias("d").join(later.hint("merge"), F.col(f"d.`{id_col}`").eqNullSafe(F.col(own)) & (F.xxhash64(F.col(f"d.`{id_col}`"), F.col(f"d.`{text_col}`")) == F.col(key)), "left")
    text, places = F.col(f"d.`{text_col}`"), lambda lines: F.transform(_counting(lines), lambda e: e["at"])
    gone = F.array_distinct(F.flatten(F.transform(F.col(starts), lambda r: F.sequence(r["s"], r["s"] + r["n"] - 1))))
    lost = lambda lines: _let(places(lines), lambda p: F.transform(gone, lambda c: F.get(p, c)))
    kept = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), lost(lines))
    short = _let(_split(text), lambda lines: F.array_join(F.transform(kept(lines), lambda p: F.get(lines, p)), "\n"))
    out = [F.when(F.col(starts).isNull(), text).otherwise(short).alias(c) if c == text_col else F.col(f"d.`{c}`") for c in docs.columns]
    if counts:
        out += [F.size(F.filter(_split(text), lambda x: F.trim(x) != "")).cast("long").alias("n_lines"), F.coalesce(F.size(F.when(F.col(starts).isNotNull(), gone)).cast("long"), F.lit(0)).alias("n_removed")]
    return joined.select(*out)


#: What ``op7_lines`` returns, by comparing lines themselves.
SQL = f"""
WITH p AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
nb AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS c FROM p WHERE trim(line) <> ''),
g AS (SELECT doc_id, c, {" || chr(10) || ".join(f"lead(trim(line), {k}) OVER w" for k in range(WINDOW))} AS gram FROM nb WINDOW w AS (PARTITION BY doc_id ORDER BY c)),
r AS (SELECT doc_id, c, row_number() OVER (PARTITION BY gram ORDER BY doc_id, c) AS nth FROM g WHERE gram IS NOT NULL),
l AS (SELECT doc_id, c, row_number() OVER (PARTITION BY trim(line) ORDER BY doc_id, c) AS nth FROM nb WHERE len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) >= {LONG_WORDS}),
gone AS (SELECT doc_id, c + k AS c FROM r, range({WINDOW}) t(k) WHERE nth > 1 UNION SELECT doc_id, c FROM l WHERE nth > 1),
j AS (SELECT p.doc_id, p.line, p.pos, nb.c, gone.c IS NOT NULL AS gone FROM p LEFT JOIN nb USING (doc_id, pos) LEFT JOIN gone ON gone.doc_id = nb.doc_id AND gone.c = nb.c)
SELECT doc_id, count(c) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text FROM j GROUP BY doc_id
"""
