"""Conversation structure repair: the cheapest edits that make a conversation alternate.

A repaired conversation is an optional system turn and then pairs of a user and an assistant
turn. Rows are kept (K), given another role (R), deleted (D), or empty turns are inserted (I).
Edit sequences are ways through a graph of layers (a layer between two rows, four states: no
turn yet, after the system turn, after a user, after an assistant). Forward and backward least
costs mark the tight arcs, those on some cheapest way; a frontier set then walks the tight arcs
and takes the least letter at each step.

A conversation of any length is cut into blocks of ``1 << BLOCK`` rows. A block acts on the
four states as a matrix of least costs, so one pass over the matrices of a conversation gives
each block its forward and backward costs, each block walks its own tight arcs for every state
it may be entered in, and a second pass links the blocks. The audit of a conversation is one
string, so there are under ``1 << 31`` rows and half a million matrices in it.

- null roles and texts are one space, a null conv_id is a conversation of its own, and null
  turns come first; rows of one turn go by role, the first 64 letters of the text and checksum;
- a row with another role than system, user or assistant is given a role or deleted; only the
  first letter of a role tells;
- equal rows are duplicates of the first; an empty table gives no conversations; other columns
  are not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgewise.session import stage

SPACES = " \t\n\x0b\x0c\r"
BLOCK = 12
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1
FAR = 1 << 50
INITIALS, FAULTS = "sua", ("none", "blank", "duplicate", "truncated")
ROLES = {2: "user", 3: "assistant"}
#: The state after a kept row by its initial, and after a row that is inserted or given the role that fits.
AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FITS = {0: 2, 1: 2, 2: 3, 3: 2}
ACCEPTED = (0, 3)


def damaged(rows: DataFrame) -> DataFrame:
    """Test damage by crc32(``conv_id:turn``) modulo 20: 0 drops a row, 1 empties it, 2 takes its stops, 3 repeats it, 4 makes it a user's."""
    id, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    at = F.crc32(F.concat(id, F.lit(":"), turn).cast("binary")) % 20
    text, role = (F.coalesce(c, F.lit(" ")) for c in ("text", "role"))
    out = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), at.alias("_at")).where("_at <> 0")
    text = F.when(F.col("_at") == 1, "").when(F.col("_at") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_at") == 4, "user").otherwise(F.col("role"))
    again = F.explode(F.sequence(F.lit(1), F.when(F.col("_at") == 3, 2).otherwise(1)))
    return out.select("conv_id", "turn", role.alias("role"), text.alias("text"), again.alias("_n")).drop("_n")


def _conv(c="conv_id") -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def numbered(rows: DataFrame) -> DataFrame:
    """The rows with a row id, written once."""
    out = rows.select(_conv().alias("conv"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    return stage(out.withColumn("rid", F.monotonically_increasing_id()), "turns")


def ordered(rows: DataFrame) -> DataFrame:
    """(at, conv, turn, rid, code): the rows of all conversations in order, without their texts.

    ``at`` counts on inside a range of the sorted rows. The code is a letter: 4 times the place
    of the initial in INITIALS (3 for others) plus that of the fault in FAULTS, from A on.
    """
    end = F.rtrim("text", F.lit(SPACES))
    ends_open = ~F.right(end, F.lit(1)).isin(".", "!", "?")
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    facts = rows.select("conv", "turn", F.substring("role", 1, 64).alias("role"), F.substring("text", 1, 64).alias("head"), digest.alias("digest"), "rid", (F.length(end) == 0).alias("blank"), ends_open.alias("open"))
    order = ["conv", F.asc_nulls_first("turn"), "role", "head", "digest"]
    facts = facts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).drop("head")
    facts = stage(facts, "turns-ordered")
    first = facts.groupBy("conv", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("new"))
    fault = F.when(F.col("blank"), 1).when(F.col("new").isNull(), 2).when(F.col("open"), 3).otherwise(0)
    initial = F.instr(F.lit(INITIALS), F.substring("role", 1, 1))
    initial = F.when(F.length("role") == 0, 3).when(initial == 0, 3).otherwise(initial - 1)
    return stage(facts.join(first, "at", "left").select("at", "conv", "turn", "rid", F.char(F.lit(65) + initial * 4 + fault).alias("code")), "turns-coded")


def _read(code: str):
    k = ord(code) - 65
    return "suax"[k // 4], FAULTS[k % 4]


def arcs(code: str) -> list:
    """(letter, state, next state, cost) of a row's arcs to the next layer."""
    initial, fault = _read(code)
    out = [("D", p, p, DELETE) for p in range(4)]
    if fault not in ("blank", "duplicate"):
        more = CUT_OFF * (fault == "truncated")
        out += [("K", p, q, KEEP + more) for (p, i), q in AFTER.items() if i == initial]
        out += [("R", p, q, REROLE + more) for p, q in FITS.items()]
    return out


def _closed(costs: list) -> list:
    """Least costs to go from each state of a layer, inserts counted."""
    for _ in range(3):
        costs = [min(costs[p], INSERT + costs[FITS[p]]) for p in range(4)]
    return costs


def _matrix(code: str) -> np.ndarray:
    """Least costs from each state of a row's layer to each of the next one, inserts before the row counted."""
    out = np.full((4, 4), FAR, np.int64)
    for q in range(4):
        direct = [min([c for _, p, t, c in arcs(code) if p == s and t == q], default=FAR) for s in range(4)]
        out[:, q] = _closed(direct)
    return out


MATRIX = {chr(65 + k): _matrix(chr(65 + k)) for k in range(16)}
ARCS = {chr(65 + k): arcs(chr(65 + k)) for k in range(16)}


@lru_cache(1 << 14)
def crossing(codes: str) -> tuple:
    """Least costs through a block, row by row of the matrix; pairs of neighbouring matrices at a time."""
    m = np.stack([MATRIX[c] for c in codes])
    while len(m) > 1:
        odd = m[len(m) & ~1 :]
        a, b = m[0 : len(m) & ~1 : 2], m[1::2]
        m = np.concatenate([np.minimum((a[:, :, :, None] + b[:, None, :, :]).min(2), FAR), odd])
    return tuple(int(x) for x in m[0].ravel())


def _illegal(initials: str) -> int:
    return sum(initials[k : k + 2] not in ("su", "ua", "au") for k in range(len(initials) - 1))


def _initials(codes: str) -> str:
    return "".join(_read(c)[0] for c in codes)


def _batches(schema: str, f):
    """A function of batches that yields the rows ``f`` gives for each input row, in batches of the ``schema``."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]

    def pack(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    def run(batches):
        rows = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                for made in f(*row):
                    rows.append(made)
                    if len(rows) == 1 << 14:
                        yield pack(rows)
                        rows = []
        yield pack(rows)

    return run


MEASURED = "conv string, b long, cross array<long>, illegal long, ends string"
COSTS = "conv string, b long, ahead array<long>, back array<long>, last int, cost long, illegal long"
WALKED = "conv string, b long, entry int, leave int, letters string"
EDITS = "conv string, at long, place int, edit string, state int"


def _measure(conv, b, at, codes):
    initials = _initials(codes)
    yield conv, b, list(crossing(codes)), _illegal(initials), initials[0] + initials[-1]


def _costs(conv, blocks):
    """Forward costs at the start and backward costs at the end of each block of a conversation."""
    blocks = [(x["b"], np.array(x["cross"], np.int64).reshape(4, 4), x["illegal"], x["ends"]) for x in blocks]
    back = [np.array(_closed([0 if p in ACCEPTED else FAR for p in range(4)]), np.int64)]
    for _, m, _, _ in reversed(blocks[1:]):
        back.append(np.minimum((m + back[-1][None, :]).min(1), FAR))
    back.reverse()
    ahead, illegal, end = np.array([0, FAR, FAR, FAR], np.int64), 0, ""
    cost = int((ahead[:, None] + blocks[0][1] + back[0][None, :]).min())
    for k, (b, m, inside, ends) in enumerate(blocks):
        illegal = inside + (_illegal(end + ends[0]) if end else 0)
        yield conv, b, ahead.tolist(), back[k].tolist(), int(k == len(blocks) - 1), cost, illegal
        ahead, end = np.minimum((ahead[:, None] + m).min(0), FAR), ends[1]


def tight_arcs(codes: str, ahead: list, back: list, cost: int, last: bool) -> list:
    """For each layer of a block, the next states by (letter, state) of the arcs on some cheapest way."""
    togo = [back]
    for c in reversed(codes):
        direct = [min(k + togo[-1][q] for _, s, q, k in ARCS[c] if s == p) for p in range(4)]
        togo.append(_closed(direct))
    togo.reverse()
    out, now = [], list(ahead)
    for k in range(len(codes) + last):
        for _ in range(3):
            for p in range(4):
                now[FITS[p]] = min(now[FITS[p]], now[p] + INSERT)
        layer = {("I", p): q for p, q in FITS.items() if now[p] + INSERT + togo[k][q] == cost}
        if k < len(codes):
            after = [FAR] * 4
            for letter, p, q, c in ARCS[codes[k]]:
                after[q] = min(after[q], now[p] + c)
                if now[p] + c + togo[k + 1][q] == cost:
                    layer[letter, p] = q
            now = after
        out.append(layer)
    return out


def frontier(layers: list, rows: int, entry: int) -> tuple:
    """The letters of the walk from ``entry`` and the set of states it ends in. A letter leads out of a state to one
    state, so ways of equal letters are one and the set keeps one state."""
    states, letters = {entry}, []
    for k, layer in enumerate(layers):
        while True:
            if k == rows and states & set(ACCEPTED):
                return "".join(letters), states
            least = min((letter for letter, p in layer if p in states), default=None)
            if least is None:
                return None, states
            states = {layer[least, p] for p in states if (least, p) in layer}
            letters.append(least)
            if least != "I":
                break
    return "".join(letters), states


def _walk(conv, b, codes, ahead, back, last, cost):
    layers = tight_arcs(codes, ahead, back, cost, bool(last))
    for entry in range(4):
        if ahead[entry] < FAR:
            letters, states = frontier(layers, len(codes), entry)
            if letters is not None:
                yield conv, b, entry, min(states), letters


def _follow(conv, blocks):
    """The state in which each block of a conversation is entered."""
    state, at = 0, None
    for b, entry, leave in sorted((x["b"], x["entry"], x["leave"]) for x in blocks):
        if b != at and entry == state:
            yield conv, b, entry
            at, state = b, leave


def _edits(conv, at, codes, entry, letters):
    """A row an edit: the row it belongs to (inserts to the next row, at the end to one past the last), its place
    before that row, the letter and the state after it."""
    state, place, rows = entry, 0, iter(codes)
    for letter in letters:
        initial = _read(next(rows))[0] if letter != "I" else ""
        if letter != "D":
            state = AFTER[state, initial] if letter == "K" else FITS[state]
        yield conv, at, place, letter, state
        place += 1
        if letter != "I":
            at, place = at + 1, 0


class Repair:
    """The repair of a table of turns (conv_id, turn, role, text); every part is a DataFrame."""

    def __init__(self, rows: DataFrame):
        self.rows = numbered(rows)
        self.order = ordered(self.rows)
        b = F.shiftright("at", BLOCK).alias("b")
        codes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "code"))), lambda x: x["code"]), "")
        self.blocks = stage(self.order.groupBy("conv", b).agg(F.min("at").alias("at"), codes.alias("codes")), "turn-blocks")
        measured = self.blocks.mapInArrow(_batches(MEASURED, _measure), MEASURED)
        gathered = measured.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("b", "cross", "illegal", "ends"))).alias("blocks"))
        self.costs = stage(gathered.mapInArrow(_batches(COSTS, _costs), COSTS), "turn-costs")
        walked = self.blocks.join(self.costs, ["conv", "b"]).select("conv", "b", "codes", "ahead", "back", "last", "cost")
        walked = stage(walked.mapInArrow(_batches(WALKED, _walk), WALKED), "turn-walks")
        entered = walked.groupBy("conv").agg(F.collect_list(F.struct("b", "entry", "leave")).alias("blocks"))
        entered = entered.mapInArrow(_batches("conv string, b long, entry int", _follow), "conv string, b long, entry int")
        self.walks = stage(walked.join(entered, ["conv", "b", "entry"]), "turn-walks")

    def audits(self) -> DataFrame:
        """(conv, audit): the letters of all edits in order."""
        parts = F.transform(F.array_sort(F.collect_list(F.struct("b", "letters"))), lambda x: x["letters"])
        return self.walks.groupBy("conv").agg(F.array_join(parts, "").alias("audit"))

    def edits(self) -> DataFrame:
        """(conv, at, place, edit, rid, role): one row an edit, in order by (at, place); the role is that which an inserted
        or changed turn gets, the row id that of the row edited, null for an inserted turn."""
        made = self.walks.join(self.blocks.select("conv", "b", "at", "codes"), ["conv", "b"]).select("conv", "at", "codes", "entry", "letters")
        made = made.mapInArrow(_batches(EDITS, _edits), EDITS)
        role = F.when(F.col("edit").isin("I", "R"), F.when(F.col("state") == 2, ROLES[2]).otherwise(ROLES[3]))
        rid = F.when(F.col("edit") != "I", F.col("rid"))
        return made.join(self.order.select("at", "rid"), "at", "left").select("conv", "at", "place", "edit", rid.alias("rid"), role.alias("role"))

    def turns(self) -> DataFrame:
        """(conv, at, place, role, text): the repaired turns, in order by (at, place)."""
        edits = self.edits().where("edit <> 'D'")
        texts = self.rows.select("rid", F.col("role").alias("old"), "text")
        out = edits.where("rid is not null").join(texts, "rid").select("conv", "at", "place", F.coalesce("role", "old").alias("role"), "text")
        return out.union(edits.where("rid is null").select("conv", "at", "place", "role", F.lit("").alias("text")))

    def digests(self) -> DataFrame:
        """(conv, sha256) of each conversation's repaired ``role:text`` lines. A digest takes its lines one after the other,
        so a conversation's lines go through one task, sorted, one batch at a time."""
        lines = self.turns().select("conv", "at", "place", F.concat("role", F.lit(":"), "text").alias("line"))

        def run(batches):
            at, sha = None, None
            for batch in batches:
                done = []
                for conv, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if conv != at:
                        if sha is not None:
                            done.append((at, sha.hexdigest()))
                        at, sha = conv, hashlib.sha256(line.encode())
                    else:
                        sha.update(b"\n")
                        sha.update(line.encode())
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], pa.string()) for k in range(2)], ["conv", "sha256"])
            if sha is not None:
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([sha.hexdigest()])], ["conv", "sha256"])

        return lines.repartition("conv").sortWithinPartitions("conv", "at", "place").select("conv", "line").mapInArrow(run, "conv string, sha256 string")

    def report(self) -> DataFrame:
        """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, sha256) of the conversations that have rows."""
        fault = F.pmod(F.ascii("code") - 65, F.lit(4))
        turns = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0))
        faults = self.order.withColumn("fault", fault).groupBy("conv").agg(
            turns.cast("long").alias("gaps"), *(F.count_if(F.col("fault") == k).alias(FAULTS[k]) for k in (1, 2, 3))
        )
        costs = self.costs.groupBy("conv").agg(F.sum("illegal").alias("illegal"), F.max("cost").alias("cost"))
        return faults.join(costs, "conv").join(self.audits(), "conv").join(self.digests(), "conv", "left")


def repairs(rows: DataFrame, all_convs: DataFrame | None = None) -> DataFrame:
    """One row a conversation of ``all_convs`` (conv_id; those of ``rows`` if left out): conv_id, gaps, blank, duplicate,
    truncated, illegal, cost, audit and repaired_sha256."""
    all_convs = (rows if all_convs is None else all_convs).select("conv_id").distinct().withColumn("conv", _conv())
    out = all_convs.join(Repair(rows).report(), "conv", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(empty)).alias("repaired_sha256"))


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: The same in DuckDB: the cheapest and then least audit of each state, row by row, with the repaired lines carried along.
ORACLE = f"""
WITH RECURSIVE tab AS (
  SELECT list(list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)
), src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))) AS x FROM conversations
), hit AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(range(CAST(length(x) / 2 AS BIGINT)), lambda c, i: xor(c >> 8, t[(xor(c, CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)) & 255) + 1]), 4294967295), 4294967295) % 20 AS code FROM src, tab
), damaged AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN replace(replace(replace(text, '.', ''), '!', ''), '?', '') ELSE text END AS text FROM hit WHERE code <> 0
  UNION ALL SELECT conv_id, turn, role, text FROM hit WHERE code = 3
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, {_BLANKS}) AS body FROM damaged
), rows_ AS MATERIALIZED (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS initial,
    CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed
), faults AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows_ GROUP BY conv_id
), arcs(p, letter, initial, q, cost, role) AS (
  VALUES (0, 'D', NULL, 0, 3, NULL), (1, 'D', NULL, 1, 3, NULL), (2, 'D', NULL, 2, 3, NULL), (3, 'D', NULL, 3, 3, NULL),
    (0, 'K', 's', 1, 0, NULL), (0, 'K', 'u', 2, 0, NULL), (1, 'K', 'u', 2, 0, NULL), (2, 'K', 'a', 3, 0, NULL), (3, 'K', 'u', 2, 0, NULL),
    (0, 'R', NULL, 2, 2, 'user'), (1, 'R', NULL, 2, 2, 'user'), (2, 'R', NULL, 3, 2, 'assistant'), (3, 'R', NULL, 2, 2, 'user')
), inserts(p, q, cost, letters, lines) AS (
  VALUES (0, 0, 0, '', []), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 2, 'I', ['user:']), (0, 3, 4, 'II', ['user:', 'assistant:']),
    (1, 2, 2, 'I', ['user:']), (1, 3, 4, 'II', ['user:', 'assistant:']), (2, 3, 2, 'I', ['assistant:']), (3, 2, 2, 'I', ['user:'])
), walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, q AS state, CAST(cost AS BIGINT) AS cost, letters AS audit, CAST(lines AS VARCHAR[]) AS lines FROM faults, inserts WHERE p = 0
  UNION ALL
  SELECT conv_id, i, state, cost, audit, lines FROM (
    SELECT w.conv_id, r.i, n.q AS state, w.cost + a.cost + n.cost + CASE WHEN r.fault = 'truncated' AND a.letter <> 'D' THEN 1 ELSE 0 END AS cost, w.audit || a.letter || n.letters AS audit,
      list_concat(list_concat(w.lines, CASE WHEN a.letter = 'D' THEN [] ELSE [coalesce(a.role, r.role) || ':' || r.text] END), n.lines) AS lines
    FROM walk w JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1 JOIN arcs a ON a.p = w.state JOIN inserts n ON n.p = a.q
    WHERE (a.letter = 'D' OR r.fault NOT IN ('blank', 'duplicate')) AND (a.initial IS NULL OR a.initial = r.initial)
    QUALIFY row_number() OVER (PARTITION BY w.conv_id, n.q ORDER BY w.cost + a.cost + n.cost + CASE WHEN r.fault = 'truncated' AND a.letter <> 'D' THEN 1 ELSE 0 END, w.audit || a.letter || n.letters) = 1)
), ended AS (
  SELECT w.* FROM walk w JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.i WHERE state IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY cost, audit) = 1
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""
