"""Spelling variants: words one edit apart, each led to its most frequent form.

Symmetric deletes: every word emits itself and its distinct single deletions, and words that
share such a key are the candidates. A key is a 64-bit number, so a word of a million letters
emits a million numbers and no text; what joins is then checked letter by letter.

- a null text has no words, a null doc_id counts as the empty text, repeated rows count again;
- an empty table gives no words; other columns are not read;
- of equally frequent neighbours the smallest in code-point order is the form.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgewise.session import stage

RUN = "[A-Za-zÀ-ÿ]+"
EVERY, LEAST_LETTERS, LEAST_COUNT, RATIO = 199, 6, 5, 5
BASE = 0x9E3779B97F4A7C15
KEYS = "key long, id long, first int, last int"


def occurrences(docs: DataFrame, every: int = EVERY) -> DataFrame:
    """(word): all letter runs of all texts in lower case (A-Z alone); where ``every`` divides the crc32 of
    ``<doc_id>:<run>``, the run loses the letter at that checksum modulo its length."""
    id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    text = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    runs = docs.select(id.alias("id"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return runs.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(id, word, n) of the words that are long and frequent enough, written once so that ids hold."""
    counted = words.where(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)
    return stage(counted.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "spelling-words")


def _emit(batches):
    """The keys of a batch of words at once. A key is the sum of letter times BASE to the power of its place, modulo 2 to
    the 64, so a deletion's key is the prefix's sum plus the rest's sum moved down one place. Deletions inside
    a stretch of equal letters are one; ``first`` and ``last`` are its places, -1 for the word itself."""
    down = np.uint64(pow(BASE, -1, 1 << 64))
    for batch in batches:
        words = batch.column(1).to_pylist()
        ids, length = batch.column(0).to_numpy(), np.array([len(w) for w in words], np.int64)
        if not len(words):
            continue
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        start = np.cumsum(length) - length
        of = np.repeat(np.arange(len(words)), length)
        place = np.arange(len(letters)) - start[of]
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(length.max(initial=1)), BASE, np.uint64)]), dtype=np.uint64)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(letters * powers[place], dtype=np.uint64)])
        whole = sums[start + length] - sums[start]
        at = np.flatnonzero((place == 0) | (letters != np.concatenate([letters[:1], letters[:-1]])))
        word = of[at]
        keys = sums[at] - sums[start[word]] + (sums[start[word] + length[word]] - sums[at + 1]) * down
        after = np.append(at[1:], len(letters))
        none = np.full(len(words), -1, np.int32)
        first = np.concatenate([none, place[at].astype(np.int32)])
        last = np.concatenate([none, (after - 1 - start[word]).astype(np.int32)])
        columns = [np.concatenate([whole, keys]).view(np.int64), np.concatenate([ids, ids[word]]), first, last]
        out = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [x.split()[0] for x in KEYS.split(", ")])
        for k in range(0, out.num_rows, 1 << 17):
            yield out.slice(k, 1 << 17)


def links(words: DataFrame) -> DataFrame:
    """(a, b, word_a, word_b, n_a, n_b): every two words at distance one, once.

    Two words meet in a key where one is a deletion of the other, or where both lose a letter at
    a common place: the join asks for that, so words two edits apart do not leave it. A pair
    has one such key, and the check compares what lies before and behind the place. The keys of
    a word are many times its size, so their join is never a broadcast.
    """
    keys = words.select("id", "word").mapInArrow(_emit, KEYS)
    a, b = (keys.select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("id", "first", "last"))) for s in "ab")
    one = F.col("first_a").eqNullSafe(-1) & (F.col("first_b") >= 0)
    both = (F.col("id_a") < F.col("id_b")) & (F.col("first_a") >= 0) & (F.col("first_b") >= 0) & (F.col("first_a") <= F.col("last_b")) & (F.col("first_b") <= F.col("last_a"))
    met = a.join(b.hint("merge"), "key").where(one | both).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "first_a", F.greatest("first_a", "first_b").alias("place"))
    met = met.join(words.select(F.col("id").alias("a"), F.col("word").alias("word_a"), F.col("n").alias("n_a")), "a")
    met = met.join(words.select(F.col("id").alias("b"), F.col("word").alias("word_b"), F.col("n").alias("n_b")), "b")
    head, rest = (lambda c: F.substring(c, F.lit(1), F.col("place"))), (lambda c: F.substring(c, F.col("place") + 2, F.length(c)))
    same = F.when(F.col("first_a") < 0, F.col("word_a") == F.concat(head("word_b"), rest("word_b"))).otherwise((head("word_a") == head("word_b")) & (rest("word_a") == rest("word_b")) & (F.col("word_a") != F.col("word_b")))
    return met.where(same).select("a", "b", "word_a", "word_b", "n_a", "n_b")


def neighbours(words: DataFrame) -> DataFrame:
    """(id, n_near, best): how many words are near, and the most frequent of them (negated count, word, id)."""
    side = lambda me, other: F.struct(F.col(me).alias("id"), F.struct((-F.col(f"n_{other}")).alias("less"), F.col(f"word_{other}").alias("word"), F.col(other).alias("id")).alias("best"))
    both = links(words).select(F.explode(F.array(side("a", "b"), side("b", "a"))).alias("x")).select("x.*")
    return both.groupBy("id").agg(F.count("*").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(id, root) of a table of pointers (id, up): the last word that each leads to. Every step doubles the way, and forms
    grow by a factor each, so there are as many steps as the logarithm of the largest count has bits."""
    now = stage(forms.select("id", F.col("up").alias("root"), F.lit(True).alias("moved")), "spelling-roots")
    while not now.where("moved").isEmpty():
        over = now.select(F.col("id").alias("root"), F.col("root").alias("over"))
        now = stage(now.join(over, "root", "left").select("id", F.coalesce("over", "root").alias("root"), F.col("over").isNotNull().alias("moved")), "spelling-roots")
    return now.select("id", "root")


def variants(docs: DataFrame, every: int = EVERY, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every frequent word of ``docs`` (doc_id, text).

    The form is the near word of largest count if that is ``ratio`` times the word's own; the
    root is where forms lead, the word itself if it has none.
    """
    words = vocabulary(occurrences(docs.select("doc_id", "text"), every), least_letters, least_count)
    near = stage(neighbours(words), "spelling-near")
    n = words.join(near, "id", "left").withColumn("led", -F.col("best.less") >= ratio * F.col("n"))
    ends = roots(n.where("led").select("id", F.col("best.id").alias("up")))
    named = words.select(F.col("id").alias("root_id"), F.col("word").alias("root_word"))
    out = n.join(ends.select("id", F.col("root").alias("root_id")), "id", "left").join(named, "root_id", "left")
    return out.select(
        "word", F.when(F.col("led"), F.col("best.word")).alias("form"), F.coalesce("root_word", "word").alias("root"),
        "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("led"), -F.col("best.less")).alias("form_n"),
    )


#: DuckDB's own crc32 is missing, so its table is made here; near words by the text around a place instead of keys.
ORACLE = """
WITH RECURSIVE tab AS (
  SELECT list(list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)
), run AS (
  SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL
), bytes AS (
  SELECT run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM run
), checked AS (
  SELECT run, n, xor(list_reduce(range(CAST(length(x) / 2 AS BIGINT)), lambda c, i: xor(c >> 8, t[(xor(c, CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)) & 255) + 1]), 4294967295), 4294967295) AS h FROM bytes, tab
), occurred AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM checked
), words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM occurred WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), holes AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT h.word, w.word, w.n FROM holes h JOIN words w ON w.word = h.rest
  UNION SELECT w.word, h.word, h.n FROM holes h JOIN words w ON w.word = h.rest
), near AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS best, max(near_n) AS best_n FROM pairs GROUP BY word
), formed AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * w.n THEN best END AS form, CASE WHEN best_n >= 5 * w.n THEN best_n END AS form_n FROM words w LEFT JOIN near USING (word)
), walk AS (
  SELECT word, word AS at FROM formed UNION ALL SELECT w.word, f.form FROM walk w JOIN formed f ON f.word = w.at WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, w.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN walk w USING (word) JOIN formed e ON e.word = w.at AND e.form IS NULL
"""
