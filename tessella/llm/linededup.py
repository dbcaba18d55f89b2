"""Line dedup by a log-template tree, in DataFrame functions only.

A line's words (A-Z and other letters in lower case) that hold a digit are a variable field, "<*>". The tree begins with a fixed
depth: a line goes down by its number of words and its first LEADING words to a leaf. In a leaf each place behind these has its most frequent word
over the distinct lines (of equal counts the greatest word). The lines that agree with these in SIMILAR of the places behind the leading
words are one template, so their other places are variable fields, too. All other lines go down further, by their word at the place with the fewest
different words (but more than one; of equal places the first), and the same is done there, until no line is left: so a leaf has as many templates as its
lines need, and a line that is like no other is a template of its own.

A template that occurs in two documents or more recurs: its lines stay in the document of the least doc_id and
are dropped from all others. Lines of fewer than LEAST words stay everywhere.

Work: the masked lines are written once. One aggregate of them by leaf finds the leaves of more than one document, and only their lines go further. Each level of
the tree is an aggregate over the distinct lines that are left. The lines of a leaf of up to LEAF_LINES distinct ones lie together, so that no
counts of words are shuffled; larger leaves go by (node, place, word), so that no task gets one. What is joined is broadcast below a checked size in bytes, and else joined by a
shuffle whose large partitions Spark splits.

Defined results: a null text stays null; an empty one stays empty. A text whose lines all go is empty. Rows without
doc_id count as one document after all others. Repeated rows are one document and keep or lose the same lines. Very long
texts are whole. Other columns are passed by, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, written

LEADING, LEAST, SIMILAR_OF, SIMILAR = 3, 4, 4, 3
#: Bytes of a joined table that are broadcast at most.
BROADCAST_BYTES = 32 << 20
#: Distinct lines of a leaf that one task takes at most.
LEAF_LINES = 20_000
_LAST = 9223372036854775807


def masked(documents: DataFrame) -> DataFrame:
    """d, h and words: the text in lower case with variable fields masked and one space between the words of a line.

    Each step is a column of its own, over whole texts before they are split, so that no step is evaluated twice.
    """
    low = documents.select(_document().alias("d"), F.xxhash64("text").alias("h"), F.lower("text").alias("t"))
    field = r"(?<![^ \t\r\f\x0B\n])[^ \t\r\f\x0B\n0-9]*+[0-9][^ \t\r\f\x0B\n]*+"
    fields = low.withColumn("t", F.when(F.col("t").rlike("[0-9]"), F.regexp_replace("t", field, "<*>")).otherwise(F.col("t")))
    single = fields.withColumn("t", F.when(F.col("t").rlike(r"[\t\r\f\x0B]|  "), F.regexp_replace("t", r"[ \t\r\f\x0B]+", " ")).otherwise(F.col("t")))
    trimmed = F.trim(F.replace(F.replace(F.col("t"), F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n")))
    return single.select("d", "h", trimmed.alias("words"))


def _lines(documents: DataFrame) -> DataFrame:
    """A row for each line of LEAST words or more, with its leaf and a hash of its masked words."""
    words = masked(documents).select("d", "h", F.posexplode(F.split("words", "\n")).alias("pos", "words"))
    counted = words.withColumn("n", F.length("words") - F.length(F.replace(F.col("words"), F.lit(" "), F.lit(""))) + 1).where(F.col("n") >= LEAST)
    return counted.withColumn("leaf", F.xxhash64("n", F.substring_index("words", " ", LEADING))).withColumn("key", F.xxhash64("words"))


def _document() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))


def _sized(df: DataFrame, width: Column | int = 48) -> DataFrame:
    """df, marked for broadcast if its rows, of `width` bytes each, are few enough."""
    width = F.lit(width) if isinstance(width, int) else width
    size = df.agg(F.coalesce(F.sum(width.cast("long")), F.lit(0)).alias("b")).first()["b"]
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def _judged(open_: DataFrame) -> DataFrame:
    """A level of the tree: whether each line is like its node's most frequent words, and else the node it goes down to."""
    counts = open_.select("node", F.posexplode("rest").alias("place", "word")).groupBy("node", "place", "word").count()
    places = counts.groupBy("node", "place").agg(F.max(F.struct("count", "word")).alias("top"), F.count(F.lit(1)).alias("words"))
    split = F.min(F.when(F.col("words") > 1, F.struct("words", "place")))["place"]
    nodes = places.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.col("top.word").alias("word")))), lambda x: x["word"]).alias("modal"), split.alias("split"))
    same = F.size(F.filter(F.zip_with("rest", "modal", lambda a, b: a == b), lambda x: x))
    judged = open_.join(nodes, "node").withColumn("fits", same * SIMILAR_OF >= F.size("rest") * SIMILAR)
    return judged.select("leaf", "key", "d1", "d2", "fits", F.when(~F.col("fits"), F.col("rest")).alias("rest"), F.when(F.col("fits"), F.col("node")).otherwise(F.xxhash64("node", "split", F.get("rest", F.col("split")))).alias("node"))


def _templates(variants: DataFrame) -> DataFrame:
    """leaf, key, d1, d2 and template of the distinct lines (leaf, key, words, d1, d2) of some leaves.

    A level of the tree is one pass; a line leaves the loop with the template of its node. Each node that is split has two words at the place of the split, so
    its children are smaller, and a node of one line is a template.
    """
    rest = F.slice(F.split("words", " "), F.lit(LEADING + 1), F.greatest(F.size(F.split("words", " ")) - LEADING, F.lit(0)))
    lines = variants.select("leaf", "key", "d1", "d2", rest.alias("rest"), F.col("leaf").alias("node"))
    large = checkpointed(variants.groupBy("leaf").count().where(F.col("count") > LEAF_LINES).select("leaf"))
    if large.isEmpty():
        return _descended(lines, together=True)
    small = _descended(lines.join(_sized(large), "leaf", "left_anti"), together=True)
    return small.unionByName(_descended(lines.join(_sized(large), "leaf", "left_semi"), together=False))


def _descended(open_: DataFrame, together: bool) -> DataFrame:
    """Templates of lines; `together`: the lines of a node meet in one partition, so that a level shuffles nothing else."""
    done = None
    while True:
        judged = checkpointed(_judged(open_.repartition("node") if together else open_))
        fits = judged.where("fits").select("leaf", "key", "d1", "d2", F.col("node").alias("template"))
        done = fits if done is None else done.unionByName(fits)
        open_ = judged.where("not fits").drop("fits")
        if open_.isEmpty():
            return done


def dropped_lines(documents: DataFrame) -> DataFrame:
    """d, h (document and hash of its text) and drops, the places of its dropped lines."""
    lines = written(_lines(documents))
    leaves = lines.groupBy("leaf").agg(F.min("key").alias("k1"), F.max("key").alias("k2"), F.min("d").alias("owner"), F.max("d").alias("last")).where("owner <> last")
    leaves = checkpointed(leaves.select("leaf", "owner", (F.col("k1") == F.col("k2")).alias("single")))
    found = lines.join(_sized(leaves.where("single")), "leaf")
    plain = found.where("d <> owner").select("d", "h", "pos")
    several = lines.join(_sized(leaves.where("not single").select("leaf")), "leaf")
    variants = checkpointed(several.groupBy("leaf", "key").agg(F.min("d").alias("d1"), F.max("d").alias("d2"), F.min("words").alias("words")))
    assigned = _templates(variants)
    recurring = assigned.groupBy("leaf", "template").agg(F.min("d1").alias("owner"), F.max("d2").alias("last")).where("owner <> last").select("leaf", "template", "owner")
    keys = checkpointed(assigned.join(recurring, ["leaf", "template"]).select("leaf", "key", "owner"))
    varied = lines.select("d", "h", "pos", "leaf", "key").join(_sized(keys), ["leaf", "key"]).where("d <> owner").select("d", "h", "pos")
    return plain.unionByName(varied).groupBy("d", "h").agg(F.collect_set("pos").alias("drops"))


def dedup_lines(documents: DataFrame) -> DataFrame:
    """The documents without their dropped lines; all columns are kept, and n_chars, if there, is counted anew."""
    out = _joined(documents).withColumn("_kept", _kept_text())
    made = {"text": F.col("_kept"), "n_chars": F.length("_kept")}
    types = {f.name: f.dataType for f in documents.schema}
    return out.select(*[made[c].cast(types[c]).alias(c) if c in made else F.col("_rest")[c].alias(c) for c in documents.columns])


def report(documents: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the digest of the kept text of each document."""
    return _joined(documents.select("doc_id", "text")).select(
        F.col("_rest.doc_id").alias("doc_id"), F.coalesce(F.size("_lines"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"), F.sha2(_kept_text(), 256).alias("kept_sha256")
    )


def _joined(documents: DataFrame) -> DataFrame:
    """_rest (all columns but the text), _lines and drops of each document."""
    drops = checkpointed(dropped_lines(documents.select("doc_id", "text")))
    rest = F.struct(*[F.col(f"`{c}`") for c in documents.columns if c not in ("text", "n_chars")])
    rows = documents.select(rest.alias("_rest"), F.split("text", "\n").alias("_lines"), _document().alias("_d"), F.xxhash64("text").alias("_h"))
    return rows.join(_sized(drops, F.size("drops") * 4 + 40), (F.col("_d") == F.col("d")) & (F.col("_h") == F.col("h")), "left")


def _kept_text() -> Column:
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("drops"))
    return F.when(F.col("drops").isNull(), F.array_join("_lines", "\n")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col("_lines"), i)), "\n"))


ORACLE_BODY = rf"""
l AS (SELECT coalesce(doc_id, {_LAST}) AS d, text, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS BIGINT) AS pos, unnest(string_split(text, chr(10))) AS line FROM docs),
w AS (SELECT d, text, pos, list_transform(list_filter(string_split_regex(lower(line), '[ \t\r\f\x0B]+'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS words FROM l),
v AS (SELECT words, len(words) AS n, words[1:{LEADING}] AS lead, min(d) AS d1, max(d) AS d2 FROM w WHERE len(words) >= {LEAST} GROUP BY words),
x AS (SELECT CAST(n AS VARCHAR) || ' ' || array_to_string(lead, ' ') AS node, words, d1, d2, true AS open FROM v
  UNION ALL
  SELECT CASE WHEN fits THEN node ELSE node || '|' || place || ' ' || words[place] END, words, d1, d2, NOT fits FROM (
    SELECT x.node, x.words, x.d1, x.d2, m.s.p AS place, len(list_filter(list_zip(x.words[{LEADING + 1}:], m.modal), lambda z: z[1] = z[2])) * {SIMILAR_OF} >= (len(x.words) - {LEADING}) * {SIMILAR} AS fits
    FROM x JOIN (SELECT node, list(word ORDER BY place) AS modal, min({{'k': k, 'p': place}}) FILTER (k > 1) AS s FROM (
      SELECT node, place, max({{'c': c, 'w': word}}).w AS word, count(*) AS k FROM (
        SELECT node, place, word, count(*) AS c FROM (SELECT node, unnest(range({LEADING + 1}, len(words) + 1)) AS place, unnest(words[{LEADING + 1}:]) AS word FROM x WHERE open) GROUP BY node, place, word) GROUP BY node, place) GROUP BY node) m ON x.node = m.node WHERE x.open)),
a AS (SELECT node, words, d1, d2 FROM x WHERE NOT open),
r AS (SELECT node, min(d1) AS owner, max(d2) AS last FROM a GROUP BY node),
k AS (SELECT a.words, r.owner FROM a JOIN r ON a.node = r.node WHERE r.owner <> r.last),
kept AS (SELECT w.d, w.text, count(k.owner) FILTER (WHERE w.d <> k.owner) AS n_dropped, coalesce(string_agg(l.line, chr(10) ORDER BY w.pos) FILTER (WHERE k.owner IS NULL OR w.d = k.owner), '') AS kept_text
  FROM (SELECT DISTINCT * FROM w) w JOIN (SELECT DISTINCT * FROM l) l ON l.d = w.d AND l.text = w.text AND l.pos = w.pos LEFT JOIN k ON k.words = w.words GROUP BY w.d, w.text)"""
ORACLE_SQL = f"""
WITH RECURSIVE docs AS (SELECT doc_id, text FROM documents), {ORACLE_BODY}
SELECT docs.doc_id, CASE WHEN docs.text IS NULL THEN 0 ELSE len(string_split(docs.text, chr(10))) END AS n_lines, coalesce(kept.n_dropped, 0) AS n_dropped, sha256(kept.kept_text) AS kept_sha256
FROM docs LEFT JOIN kept ON kept.d = coalesce(docs.doc_id, {_LAST}) AND kept.text = docs.text
"""
