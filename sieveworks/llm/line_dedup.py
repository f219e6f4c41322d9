"""Line deduplication by a deletion-neighbourhood join, in DataFrame functions only.

A line is its words, cut at spaces; runs of spaces and spaces at the ends count as one cut or none. A line
of at least `min_words` words goes if an earlier one (by doc_id, then place in the document) is within one
word edit: equal in words, or one word replaced, inserted or deleted. A line with at least `min_words` - 1
spaces goes if an earlier one is equal; with `short_equal` any line that is not blank does. Other lines
stay, as the SQL of op3_line_dedup has it.

1. Lines are reduced to fixed-width rows (hashes of the line and of its halves) and summed to distinct
   lines with their first place, so that a line of any number of copies is one row from there on.
2. Two lines within one edit share their first or their second half, taken for the length of the shorter
   one. Only distinct lines that share such a half with another line go on.
3. Each of these emits its whole deletion neighbourhood: for every word the key of the line without it, and
   for every gap the key of the line split there. A replacement makes two deletion keys equal, an insertion
   a deletion key and a gap key. Keys are built from running exclusive-or sums, so that a line of n words
   costs n rows however long it is.
4. Equal keys are joined through the earliest line of each key, never as pairs of all lines that share it.
   As any two partners under one key are within one edit, the earliest partner decides; its edit distance
   is then verified on the words.

Defined results: null text has no lines and stays null; an empty text keeps its one empty line; rows that
repeat in id and text are one document and are treated alike; distinct texts under one id are separate;
lines at the same place under the same id are not earlier than each other; a null id sorts first; an empty
table stays empty; all columns of the input are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveworks.llm._common import cut, drop_cut

MIN_WORDS = 5
_BLANK = " \t\n\v\f\r"


#: A document row by 128 bits of its id and text, so that no two of any corpus are taken for one.
_RID = ["rid", "rid_b"]


def _rid(doc_id: str, text: str) -> list[Column]:
    return [F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)).alias(name) for seed, name in zip((7, 11), _RID)]


def _first_place(doc_id: str) -> Column:
    """The place of a document's first line: one number that sorts by id, and with a line's place in the document added by id, then place."""
    first = F.coalesce(F.col(doc_id).cast("decimal(20,0)"), F.lit(-(2**63)).cast("decimal(20,0)"))
    return (first * F.lit(2**31).cast("decimal(10,0)")).cast("decimal(31,0)")


def _pieces(line: str) -> Column:
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _lines(docs: DataFrame, doc_id: str, text: str, min_words: int, short_equal: bool) -> DataFrame:
    """rid, rid_b, pos, place, h1, h2, line: the lines that are compared, as they stand in the texts."""
    # the whole text is hashed once, below the explosion into lines; split gives no empty array, and _outer spares the filter that would split again
    whole = docs.where(F.col(text).isNotNull()).select(*_rid(doc_id, text), _first_place(doc_id).alias("_first"), F.split(text, "\n", -1).alias("_parts"))
    one = whole.select(*_RID, "_first", F.posexplode_outer("_parts").alias("pos", "line"))
    long = _pieces("line") >= min_words
    one = one.where(long | (F.trim("line", F.lit(_BLANK)) != "") if short_equal else long)
    place = (F.col("_first") + F.col("pos").cast("decimal(10,0)")).cast("decimal(31,0)")
    return one.select(*_RID, "pos", place.alias("place"), F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"), "line")


def _without_surplus(lines: DataFrame, *columns: str) -> DataFrame:
    """The columns, n and line: lines as words with one space between, and their number."""
    trimmed = F.trim("line")
    words = F.when(F.contains(trimmed, F.lit("  ")), F.regexp_replace(trimmed, "  +", " ")).otherwise(trimmed)
    return lines.select(*columns, words.alias("line")).select(*columns, _pieces("line").alias("n"), "line")


def _outer(line: str, count: Column) -> Column:
    """The first words of a line, the last ones if count is negative."""
    return F.call_function("substring_index", F.col(line), F.lit(" "), count)


def _halves(line: str, n: str) -> list[Column]:
    """The half keys of a line, as the shorter (length n) and as the longer (length n - 1) of a pair.

    A half is what stands before or after its space in the line itself; the words are not cut apart for it.
    """

    def keys(m: Column) -> list[Column]:
        h = F.shiftright(m, 1)
        return [F.xxhash64(F.lit("first"), m, _outer(line, h)), F.xxhash64(F.lit("second"), m, _outer(line, h - m))]

    return [*keys(F.col(n)), *keys(F.col(n) - 1)]


def _neighbourhood(lines: DataFrame) -> DataFrame:
    """h1, h2, place, key, gap: the keys of every line's deletions and gaps."""
    words = lines.select("h1", "h2", "place", "n", F.posexplode(F.split("line", " ", -1)).alias("i", "word"))
    hashed = words.select(
        "h1", "h2", "place", "n", "i",
        F.xxhash64(F.lit("l"), "word", "i").alias("from_left"), F.xxhash64(F.lit("r"), "word", F.col("n") - F.col("i")).alias("from_right"),
    )
    line = Window.partitionBy("h1", "h2").orderBy("i")
    so_far = line.rowsBetween(Window.unboundedPreceding, 0)
    hashed = hashed.select(
        "*", F.expr("bit_xor(from_left)").over(so_far).alias("left"), F.expr("bit_xor(from_right)").over(so_far).alias("right_so_far"),
        F.expr("bit_xor(from_right)").over(Window.partitionBy("h1", "h2")).alias("right_all"),
    )
    before = F.col("left").bitwiseXOR(F.col("from_left"))
    right_after = F.col("right_all").bitwiseXOR(F.col("right_so_far"))
    right_from = right_after.bitwiseXOR(F.col("from_right"))
    deletion = F.struct(F.xxhash64(before, right_after, "i", F.col("n") - 1).alias("key"), F.lit(False).alias("gap"))
    gap = F.struct(F.xxhash64(before, right_from, "i", "n").alias("key"), F.lit(True).alias("gap"))
    last = F.struct(F.xxhash64("left", right_after, F.col("i") + 1, "n").alias("key"), F.lit(True).alias("gap"))
    own = F.when(F.col("i") + 1 == F.col("n"), F.array(deletion, gap, last)).otherwise(F.array(deletion, gap))
    return hashed.select("h1", "h2", "place", F.explode(own).alias("k")).select("h1", "h2", "place", "k.key", "k.gap")


def one_edit(a: Column, b: Column) -> Column:
    """Whether two word arrays are within one replacement, insertion or deletion."""
    n, m = F.size(a), F.size(b)
    same = F.size(F.filter(F.sequence(F.lit(0), F.least(n, m) - 1), lambda i: F.get(a, i) != F.get(b, i)))
    first = F.array_position(F.transform(F.sequence(F.lit(0), F.least(n, m) - 1), lambda i: (F.get(a, i) != F.get(b, i)).cast("int")), F.lit(1)).cast("int")
    at = F.when(first == 0, F.least(n, m) + 1).otherwise(first)  # the first place from 1 where they differ
    rest = lambda x, k: F.slice(x, at + k, F.greatest(F.size(x) - at - k + 1, F.lit(0)))
    return (
        F.when(n == m, same <= 1)
        .when(n == m + 1, rest(a, 1) == rest(b, 0))
        .when(m == n + 1, rest(b, 1) == rest(a, 0))
        .otherwise(False)
    )


def duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, short_equal: bool = False) -> DataFrame:
    """rid, rid_b, pos, near: the lines that go, by document row and place; near: not equal to an earlier line."""
    lines = _lines(docs, doc_id, text, min_words, short_equal)
    halves = [F.when(F.col("n") >= min_words, k).alias(f"k{i}") for i, k in enumerate(_halves("line", "n"))]  # null: compared as a whole only
    each = [*_RID, "pos", "place", "h1", "h2"]
    narrow = cut(_without_surplus(lines, *each).select(*each, *halves), "lines")
    distinct = cut(
        narrow.groupBy("h1", "h2").agg(
            F.min("place").alias("place"), F.count(F.lit(1)).alias("copies"), F.max("place").alias("last_place"), *[F.min(f"k{i}").alias(f"k{i}") for i in range(4)]
        ),
        "distinct",
    )
    halves = distinct.select("h1", "h2", "place", F.explode(F.array(*[F.col(f"k{i}") for i in range(4)])).alias("k")).where("k IS NOT NULL")
    shared = halves.groupBy("k").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("k")
    members = cut(halves.join(shared, "k", "left_semi").groupBy("h1", "h2").agg(F.min("place").alias("place")), "members")
    texts = lines.select("h1", "h2", "place", "line").join(members, ["h1", "h2", "place"])
    texts = cut(_without_surplus(texts.dropDuplicates(["h1", "h2"]), "h1", "h2", "place"), "texts")
    drop_cut(members)
    keys = cut(_neighbourhood(texts), "keys")
    least = keys.groupBy("key").agg(
        F.count(F.lit(1)).alias("c"), F.min(F.when(~F.col("gap"), F.col("place"))).alias("by_deletion"), F.min(F.when(F.col("gap"), F.col("place"))).alias("by_gap")
    )
    least = least.where("c > 1 AND by_deletion IS NOT NULL").drop("c")
    partner = F.when(F.col("gap"), F.col("by_deletion")).otherwise(F.least("by_deletion", "by_gap"))
    found = keys.join(least, "key").select("h1", "h2", "place", partner.alias("partner")).where("partner < place")
    found = cut(found.groupBy("h1", "h2").agg(F.min("partner").alias("partner")), "partners")
    drop_cut(keys)
    earlier = texts.select(F.col("place").alias("partner"), F.split("line", " ", -1).alias("b"))
    near = (
        texts.select("h1", "h2", F.split("line", " ", -1).alias("a")).join(found, ["h1", "h2"]).join(earlier, "partner")
        .where(one_edit(F.col("a"), F.col("b"))).select("h1", "h2", F.lit(True).alias("near")).distinct()
    )
    near = cut(near, "near")
    drop_cut(texts, found)
    gone = distinct.where("copies > 1 AND last_place > place").select("h1", "h2", F.col("place").alias("first")).join(near, ["h1", "h2"], "full_outer")
    hit = narrow.select(*_RID, "pos", "place", "h1", "h2").join(gone, ["h1", "h2"])
    equal = F.coalesce(F.col("place") > F.col("first"), F.lit(False))
    out = cut(hit.where("near OR place > first").select(*_RID, "pos", (F.coalesce("near", F.lit(False)) & ~equal).alias("near")).distinct(), "gone")
    drop_cut(narrow, distinct, near)
    return out


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, short_equal: bool = False) -> DataFrame:
    """The rows of docs with their text without duplicate lines, and what went, in `_lines_gone` and `_near_gone` (replacing columns of these names).

    Only the places of lines that go are gathered per document; the text is filtered in place.
    """
    gone = duplicates(docs, doc_id, text, min_words, short_equal)
    by_doc = gone.groupBy(*_RID).agg(F.collect_list("pos").alias("places"), F.sum(F.col("near").cast("int")).alias("n_near"))
    joined = docs.select(F.struct("*").alias("row"), F.col(text).alias("body"), *_rid(doc_id, text)).join(by_doc, _RID, "left")
    # a column of its own: inside the lambda below the text would be split again for each of its lines
    own = [c for c in docs.columns if c not in ("_lines_gone", "_near_gone")]
    fields = [F.col("row").getField(c).alias(f"_{i}") for i, c in enumerate(own)]
    joined = joined.select(*fields, "body", "places", "n_near", F.when(F.col("places").isNotNull(), F.split("body", "\n", -1)).alias("lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "places")
    left = F.when(F.col("places").isNull(), F.col("body")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    return joined.select(
        *[(left if c == text else F.col(f"_{i}")).alias(c) for i, c in enumerate(own)],
        F.coalesce(F.size("places"), F.lit(0)).alias("_lines_gone"), F.coalesce("n_near", F.lit(0)).alias("_near_gone"),
    )
