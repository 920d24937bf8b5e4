"""Line dedup by a log-template tree of fixed depth.

A line goes down the tree by its token count and its first ``DEPTH`` tokens, where a
token with a digit counts as a variable field. In a leaf, a token stays part of the
template at its place if at least ``min_docs`` documents have it there; every other
token is a variable field. A template recurs if ``min_docs`` documents hold a line of it
and enough of its tokens are constant. Of a recurring template the first line, by
document and place, stays; all others are dropped. Documents stay, even if no line does.

DataFrame operations only. The lines are made once and written. A leaf with too few lines
for any template is cut off before its tokens are counted; equal lines are counted once a
leaf with the number of their documents, so a very common line is one row there. Leaves,
shapes and templates are written before they meet the lines, so that those joins may split
a hot key.

Defined cases: null text stays null; empty lines and lines under ``MIN_TOKENS`` tokens
always stay, as a template of one or two words is no sign of a copy; a line of ``MIN_TOKENS``
tokens only goes if all are constant; rows equal in doc_id and text are one document, lose the
same lines and report the same counts; a null doc_id comes first; extra columns pass through,
whatever their names, but ``_lines`` and ``_dropped`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgewise.session import release, stage

DEPTH = 3
MIN_TOKENS = 3
MIN_DOCS = 3
#: Share of a template's tokens that must be constant, in percent.
CONSTANT = 75
BLANK = r"[\x20\x09-\x0D]+"
#: A token with a digit, in a line with single blanks.
DIGITS = r"(?<![^\x20])[^\x20]*?[0-9][^\x20]*"


def _lines(docs: DataFrame) -> DataFrame:
    """Lines that can belong to a template: document key, place, leaf, kind and the masked line.

    Plain string functions do for most lines; a pattern only runs on those that need it.
    """
    lines = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("version"), F.posexplode(F.split("text", "\n")).alias("place", "line"))
    line, keys = F.col("line"), ["doc_id", "version", "place"]
    odd = line.contains("  ") | line.startswith(" ") | line.endswith(" ")
    for c in "\t\x0b\x0c\r":
        odd = odd | line.contains(c)
    # The explode of one value keeps the optimizer from repeating its expression in every use.
    lines = lines.select(*keys, F.explode(F.array(F.when(odd, F.trim(F.regexp_replace(line, BLANK, " "))).otherwise(line))).alias("line"))
    lines = lines.select(*keys, F.explode(F.array(F.when(line.rlike("[0-9]"), F.regexp_replace(line, DIGITS, "<*>")).otherwise(line))).alias("line"))
    size = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "))) + 1
    leaf = F.xxhash64(size, F.substring_index("line", " ", DEPTH))
    return lines.where(size >= MIN_TOKENS).select("doc_id", "version", "place", leaf.alias("leaf"), F.xxhash64("line").alias("kind"), "line")


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, version, place) of every line of ``docs`` (doc_id, text) that is dropped."""
    lines = stage(_lines(docs), "lines")
    leaves = stage(lines.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("leaf"), "leaves")
    # The exchange behind the join is what lets it split a hot leaf.
    kinds = lines.join(leaves.hint("shuffle_hash"), "leaf").select("leaf", "kind", "line", "doc_id", "version")
    kinds = kinds.repartition("leaf", "kind", "doc_id", "version").distinct()
    kinds = kinds.groupBy("leaf", "kind", "line").agg(F.count("*").alias("docs"))
    kinds = stage(kinds.select("leaf", "kind", "docs", F.split("line", " ").alias("tokens")), "kinds")
    tokens = kinds.select("leaf", "kind", "docs", F.posexplode("tokens").alias("at", "token"))
    tokens = tokens.where((F.col("at") >= DEPTH) & (F.col("token") != "<*>"))
    common = tokens.groupBy("leaf", "at", "token").agg(F.sum("docs").alias("d")).where(F.col("d") >= min_docs).select("leaf", "at", "token")
    common = stage(common, "common-tokens")
    part = F.xxhash64("at", "token").cast("decimal(38,0)")
    constants = tokens.join(common, ["leaf", "at", "token"]).groupBy("leaf", "kind").agg(F.sum(part).alias("shape"), F.count("*").alias("constant"))
    head = F.expr(f"size(filter(slice(tokens, 1, {DEPTH}), x -> x <> '<*>'))")
    shapes = kinds.select("leaf", "kind", F.size("tokens").alias("n"), head.alias("head")).join(constants, ["leaf", "kind"], "left")
    held = F.col("head") + F.coalesce("constant", F.lit(0))
    shapes = shapes.where((held >= MIN_TOKENS) & (100 * held >= CONSTANT * F.col("n"))).select("leaf", "kind", F.coalesce("shape", F.lit(0).cast("decimal(38,0)")).alias("shape"))
    shapes = stage(shapes, "shapes")
    shaped = stage(lines.select("doc_id", "version", "place", "leaf", "kind").join(shapes, ["leaf", "kind"]).drop("kind"), "shaped")
    release(lines, leaves, kinds, common, shapes)
    place = F.struct("doc_id", "version", "place")
    per_doc = shaped.groupBy("leaf", "shape", "doc_id", "version").agg(F.min(place).alias("first"))
    recurring = per_doc.groupBy("leaf", "shape").agg(F.count("*").alias("d"), F.min("first").alias("first")).where(F.col("d") >= min_docs)
    recurring = stage(recurring.select("leaf", "shape", "first"), "templates")
    out = shaped.join(recurring, ["leaf", "shape"])
    return out.where(~place.eqNullSafe(F.col("first"))).select("doc_id", "version", "place")


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` without recurring lines, with ``_lines`` and ``_dropped`` counts."""
    gone = recurring_lines(docs, min_docs).groupBy(F.col("doc_id").alias("_id"), F.col("version").alias("_v")).agg(F.collect_set("place").alias("_places"))
    # One struct keeps the columns of ``docs`` apart from those made here.
    keyed = docs.select(F.struct("*").alias("_row"), F.xxhash64("text").alias("_version"))
    out = keyed.join(gone.hint("shuffle_hash"), F.col("_row.doc_id").eqNullSafe(F.col("_id")) & (F.col("_version") == F.col("_v")), "left")
    out = out.select("_row", F.col("_row.text").alias("_text"), "_places")
    size = F.octet_length("_text") - F.octet_length(F.replace("_text", F.lit("\n"))) + 1
    # The struct holds the split text, so that it is split once and not for each line kept.
    rest = F.expr("aggregate(array(named_struct('l', split(_text, '\\n'), 'k', array_except(sequence(0, octet_length(_text) - octet_length(replace(_text, '\\n')) ), _places))), '', (a, x) -> array_join(transform(x.k, i -> get(x.l, i)), '\\n'))")
    text = F.when(F.col("_places").isNull(), F.col("_text")).otherwise(rest)
    counts = [F.when(F.col("_text").isNotNull(), size).otherwise(0).alias("_lines"), F.when(F.col("_places").isNull(), 0).otherwise(F.size("_places")).alias("_dropped")]
    kept = [c for c in docs.columns if c not in ("_lines", "_dropped")]
    return out.select(*(text.alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in kept), *counts)


ORACLE = f"""
WITH raw AS (
  SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL
), numbered AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS place
  FROM raw
), words AS (
  SELECT doc_id, text, place,
         [CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END
          FOR x IN string_split_regex(line, '[\\x20\\x09-\\x0D]+') IF x <> ''] AS tokens
  FROM numbered
), lines AS (
  SELECT *, len(tokens) AS n, tokens[1:{DEPTH}] AS head FROM words WHERE len(tokens) >= {MIN_TOKENS}
), kinds AS (
  SELECT n, head, tokens, count(DISTINCT (doc_id, text)) AS docs FROM lines GROUP BY ALL
), places AS (
  SELECT n, head, tokens, docs, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM kinds
), common AS (
  SELECT n, head, pos, token FROM places WHERE token <> '<*>' GROUP BY ALL HAVING sum(docs) >= {MIN_DOCS}
), shapes AS (
  SELECT p.n, p.head, p.tokens,
         list(CASE WHEN c.token IS NULL AND p.pos > {DEPTH} THEN '<*>' ELSE p.token END ORDER BY p.pos) AS shape,
         count(*) FILTER (p.token <> '<*>' AND (p.pos <= {DEPTH} OR c.token IS NOT NULL)) AS held
  FROM places p LEFT JOIN common c USING (n, head, pos, token) GROUP BY ALL
), shaped AS (
  SELECT l.doc_id, l.text, l.place, s.shape
  FROM lines l JOIN shapes s USING (n, head, tokens)
  WHERE s.held >= {MIN_TOKENS} AND 100 * s.held >= {CONSTANT} * s.n
), recurring AS (
  SELECT shape, count(DISTINCT (doc_id, text)) AS d, min(doc_id) AS doc FROM shaped GROUP BY shape HAVING count(DISTINCT (doc_id, text)) >= {MIN_DOCS}
), firsts AS (
  SELECT s.shape, r.doc, min(s.place) AS place FROM shaped s JOIN recurring r ON s.shape = r.shape AND s.doc_id = r.doc GROUP BY ALL
), gone AS (
  SELECT s.doc_id, list(s.place) AS places FROM shaped s JOIN firsts f USING (shape)
  WHERE NOT (s.doc_id = f.doc AND s.place = f.place) GROUP BY s.doc_id
)
SELECT d.doc_id, len(string_split(d.text, chr(10)))::BIGINT AS n_lines, coalesce(len(g.places), 0)::BIGINT AS n_dropped,
       md5(CASE WHEN g.places IS NULL THEN d.text ELSE array_to_string(
         [string_split(d.text, chr(10))[i + 1] FOR i IN range(len(string_split(d.text, chr(10)))) IF NOT list_contains(g.places, i)], chr(10)) END) AS text_md5
FROM documents d LEFT JOIN gone g USING (doc_id)
"""
