"""Spelling variants, archives and conversation repair against brute-force versions, and their defined odd cases."""

import gzip
import hashlib
import itertools
import random
import re
import uuid
import zlib
from base64 import b32encode
from collections import Counter

import pytest
from pyspark.sql import functions as F

from edgewise.llm import archives, spelling, turn_repair

# spelling variants


def spelt(rows, every=199, letters=6, count=5, ratio=5):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= letters and c >= count}

    def one(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    out = {}
    for w in n:
        near = [v for v in n if v != w and one(v, w)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        out[w] = [best if best is not None and n[best] >= ratio * n[w] else None, len(near)]

    def root(w):
        while out[w][0] is not None:
            w = out[w][0]
        return w

    return {(w, f, root(w), n[w], near, n[f] if f else None) for w, (f, near) in out.items()}


def spelling_of(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, word string, n int, key string")
    return {tuple(r) for r in spelling.variants(df, **options).collect()}


def test_variants_equal_brute_force(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abÿé") for _ in range(rng.randint(5, 8))) for _ in range(60)]
    words += ["aaaaaa", "aaaaaaa", "aaaaaaaa", "aaabaaa", "Àbcdef", "àbcdef", "ABCDEF", "abcdéf"]
    rows = [(k, " ".join(rng.choices(words, weights=[3 ** (j % 6) for j in range(len(words))], k=120))) for k in range(40)]
    for every in (3, 199):
        assert spelling_of(spark, rows, every=every) == spelt(rows, every)


def test_variants_of_chains_ties_and_odd_rows(spark):
    rows = [(1, None), (None, "lettre lettre"), (2, ""), (3, "123 ... \n"), (4, "x" * 70_000)]
    rows += [(5, " ".join(["lettre"] * 5 + ["lettrs"] * 40 + ["lettry"] * 300 + ["setter"] * 30 + ["lettel"] * 30 + ["leTTre"]))] * 2
    rows += [(6, " ".join(["x" * 70_000] * 2 + ["x" * 69_999] * 3))] * 5
    got = spelling_of(spark, rows, every=10**9)
    assert got == spelt(rows, 10**9)
    by = {r[0]: r for r in got}
    assert by["lettre"][1:3] == ("lettry", "lettry") and by["x" * 69_999][4] == 1


def test_roots_follow_long_chains(spark):
    found = spelling.roots(spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (102, 101)], "id long, up long"))
    assert {tuple(r) for r in found.collect()} == {(k, 40) for k in range(40)} | {(100, 101), (102, 101)}


def test_variants_of_an_empty_table(spark):
    assert spelling_of(spark, []) == set()


# archives


def b32(data: bytes) -> str:
    return b32encode(hashlib.sha1(data).digest()).decode()


def put(folder, name, data: bytes):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(data)
    return str(folder)


BLOCK_1 = b"1 0 Somebody\nURL IP-address Archive-date Content-type Archive-length\n"
BLOCK_2 = b"2 0 Somebody\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
HTTP = b"HTTP/1.0 200 OK\nContent-Type: text/html\n\n"


def test_reads_both_versions_and_what_is_wrong(spark, tmp_path):
    raw = bytes(range(256)) * 3
    one = b"filedesc://one.arc 0.0.0.0 19990102030405 text/plain %d\n" % len(BLOCK_1) + BLOCK_1
    one += b"\nhttp://a.b/c d 1.2.3.4 19990101 text/html %d\n" % len(HTTP + raw) + HTTP + raw
    one += b"\nnot a header line\n\nhttp://a.b/2 1.2.3.4 tomorrow text/html 5\nab\ncd\n\ndns:a.b 1.2.3.4 19990102030406 text/dns 3\nxyz\nhttp://a.b/3 1.2.3.4 19990102030407 text/html 50\nshort"
    two = b"filedesc://two.arc 0.0.0.0 19990102030405 text/plain 200 - - 0 two.arc %d\n" % len(BLOCK_2) + BLOCK_2
    sums = hashlib.md5(b"abc").hexdigest().encode()
    two += b"\nhttp://a.b/ 1.2.3.4 19990102030405 image/gif 200 %s - 120 two.arc 3\nabc\nhttp://a.b/ 1.2.3.4 19990102030405 image/gif 404 %s - 130 two.arc 3\nabd\n" % (sums, sums)
    put(tmp_path / "arc", "1.arc", one)
    # a member each record, as archives are compressed
    parts = [x for x in re.split(b"(?<=\n)(?=http)", two)]
    put(tmp_path / "arc", "2.arc.gz", b"".join(gzip.compress(x) for x in parts))
    got = [r.asDict() for r in archives.read_arc(spark, str(tmp_path / "arc")).collect()]
    first = {(r["url"], r["problem"]): r for r in got if r["file"].endswith("1.arc")}
    assert set(first) == {("filedesc://one.arc", None), ("http://a.b/c d", None), (None, "header"), ("http://a.b/2", "date"), ("dns:a.b", None), ("http://a.b/3", "length")}
    assert bytes(first["http://a.b/c d", None]["block"]) == HTTP + raw and bytes(first["http://a.b/2", "date"]["block"]) == b"ab\ncd"
    assert bytes(first["http://a.b/3", "length"]["block"]) == b"short" and first["http://a.b/2", "date"]["date"] == "19990102030405"
    second = [(r["url"], r["status"], r["problem"], bytes(r["block"])) for r in got if not r["file"].endswith("1.arc")]
    assert second[1:] == [("http://a.b/", "200", None, b"abc"), ("http://a.b/", "404", "checksum", b"abd")]
    for r in got:
        data = one if r["file"].endswith("1.arc") else two
        assert data[r["offset"] :].startswith((r["url"] or "not a header line").encode())

    archives.converted(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    back = [r.asDict() for r in archives.read_warc(spark, str(tmp_path / "warc")).collect()]
    made = {r["uri"]: r for r in back if r["type"] == "response"}
    assert bytes(made["http://a.b/c d"]["block"]) == HTTP + raw and made["http://a.b/c d"]["stored_digest"] == b32(raw) and made["http://a.b/c d"]["date"] == "1999-01-01T00:00:00Z"
    kinds = Counter(r["type"] for r in back)
    assert kinds == {"warcinfo": 2 + sum(r["uri"] is None and "WARC-Filename: converted" in r["headers"] for r in back), "response": 1, "resource": 5, "metadata": 1}
    assert len({r["record_id"] for r in back}) == len(back) and all(uuid.UUID(r["record_id"].removeprefix("urn:uuid:")) for r in back)
    assert sum("WARC-Truncated: length" in r["headers"] for r in back) == 1


PAGES = "page_id long, url string, html string, file string, offset long, type string, block string"


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "f", 0, "t", "b") for i, u, h in rows], PAGES)


def expected(rows, least=0):
    groups = {}
    for i, _, h in rows:
        groups.setdefault((h or "").encode(), []).append(-1 if i is None else i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        best = max(groups[data])
        again = len(data) >= least and best >= 0 and (i is None or i < best)
        out.append((i, len(data), b32(data), "revisit" if again else "response", best if again else None))
    return Counter(out)


@pytest.mark.parametrize("least", [0, 20])
def test_archives_hold_pages_and_revisits(spark, least):
    long_ = "<p>é 𝄞</p>\r\n\r\nWARC/1.0\r\n\r\n\nhttp://x 1.2.3.4 20000101000000 text/html 3\n" * 3000
    rows = [(k, f"http://h/{k}", f"<html>{k % 7} body of this page</html>") for k in range(60)]
    rows += [(100, None, None), (101, "", ""), (102, "http://a b/\tc", long_), (103, "http://h", long_), (103, "http://h", long_), (None, "http://n", long_), (None, "http://n", "<p>none</p>"), (None, "http://n", "<p>none</p>"), (104, "http://s", "one"), (105, "http://s", "one")]
    got = archives.archived(pages_of(spark, rows), least)
    assert Counter(tuple(r) for r in got.drop("url").collect()) == expected(rows, least)
    assert {r.url for r in got.where("page_id in (100, 102)").collect()} == {"urn:none", "http://a%20b/%09c"}


def test_archives_cut_files_at_their_size(spark, tmp_path):
    rows = [(k, f"http://h/{k}", f"<p>{k}</p>" * 300) for k in range(50)]
    captures = archives.captures(pages_of(spark, rows), F.when(F.col("page_id") % 2 == 0, 1).otherwise(2)).coalesce(2)
    path = archives.write_arc(captures, str(tmp_path / "arc"), file_bytes=20_000)
    files = list((tmp_path / "arc").glob("part-*"))
    assert len(files) > 5
    for f in files:
        data = gzip.decompress(f.read_bytes())
        assert data.startswith(b"filedesc://") and len(data) < 20_000 + 4_000
    got = archives.read_arc(spark, path).where("url not like 'filedesc%'").select("url", "problem").collect()
    assert Counter(tuple(r) for r in got) == Counter((u, None) for _, u, _ in rows)


def test_archives_of_an_empty_table(spark):
    assert archives.archived(pages_of(spark, [])).collect() == []


# conversation repair


def hit(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        code = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def repaired(rows):
    """The report of one conversation's rows: cheapest and then least audits over all edit sequences, row by row."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, best = set(), {"": (0, "", ())}
    count = Counter()
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    names = {"u": "user", "a": "assistant"}

    def insert(best):
        out = dict(best)
        for _ in range(3):
            for state, (cost, audit, lines) in list(out.items()):
                for to in set(step[state]) - {"s"}:
                    new = (cost + 2, audit + "I", lines + (f"{names[to]}:",))
                    out[to] = min(out.get(to, new), new)
        return out

    for _, _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        count[fault] += 1
        after = {}
        for state, (cost, audit, lines) in insert(best).items():
            ways = [(state, 3, "D", lines)]
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                ways += [(to, more, "K", lines + (f"{role}:{text}",)) for i, to in step[state].items() if i == role[:1]]
                ways += [(to, 2 + more, "R", lines + (f"{names[to]}:{text}",)) for to in set(step[state]) - {"s"}]
            for to, c, letter, made in ways:
                new = (cost + c, audit + letter, made)
                after[to] = min(after.get(to, new), new)
        best = after
    cost, audit, lines = min(v for k, v in insert(best).items() if k in ("", "a"))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    return gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def reports(rows, all_rows=None):
    by = {c: [] for c in [r[0] for r in (all_rows or rows)]}
    for r in rows:
        by[r[0]].append(r)
    return {(c, *repaired(v)) for c, v in by.items()}


TURNS = "conv_id long, turn long, role string, text string, at long, conv string, b long, code string, letters string"


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, 5, "c", 6, "d", "e") for r in rows], TURNS)


def talk(rng, convs, longest):
    roles, texts = ["user", "assistant", "system", "user", "assistant", "tool", "", None], ["Yes.", "No!", "Hm", "", " \n", "Why?  ", "a.b", None]
    out = []
    for c in convs:
        n = rng.randint(1, longest)
        for k in range(n):
            text = rng.choice(texts) if rng.random() < 0.5 else f"Text {rng.random()}."
            out.append((c, None if rng.random() < 0.05 else k + rng.randint(0, 1), rng.choice(roles), text))
    return out


@pytest.mark.parametrize("block", [0, 2, 12])
def test_repair_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(turn_repair, "BLOCK", block)
    rows = talk(random.Random(block), [None, *range(60)], 14)
    df = turns_of(spark, rows)
    got = {tuple(r) for r in turn_repair.repairs(turn_repair.damaged(df), df).collect()}
    assert got == reports(hit(rows), rows)
    assert {tuple(r) for r in turn_repair.repairs(df).collect()} == reports([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows])


def test_repair_of_one_very_long_conversation_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(turn_repair, "BLOCK", 5)
    rng = random.Random(3)
    rows = talk(rng, [1], 1) + [(7, k, rng.choice(["user", "assistant", "system"]), f"Turn {k % 900}{'.' if k % 5 else ''}") for k in range(3000)] + [(8, 0, "user", "long " * 200_000 + "."), (8, 1, "assistant", " " * 300_000)]
    got = {tuple(r) for r in turn_repair.repairs(turns_of(spark, rows)).collect()}
    assert got == reports([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows])


def test_repaired_turns_alternate_and_keep_their_texts(spark):
    rows = talk(random.Random(5), range(40), 9)
    out = turn_repair.Repair(turns_of(spark, rows)).turns().orderBy("conv", "at", "place").collect()
    by = {}
    for r in out:
        by.setdefault(r.conv, []).append(r)
    texts = {(str(c), " " if x is None else x) for c, _, _, x in rows}
    for conv, turns in by.items():
        assert re.fullmatch("s?(ua)+", "".join(t.role[0] for t in turns))
        assert all(t.text == "" or (conv, t.text) in texts for t in turns)


def test_repair_of_empty_tables_and_of_conversations_without_rows(spark):
    none = hashlib.sha256(b"").hexdigest()
    df = turns_of(spark, [(9, 1, "user", "Hello.")])
    assert [tuple(r) for r in turn_repair.repairs(df.where("turn > 1"), df).collect()] == [(9, 0, 0, 0, 0, 0, 0, "", none)]
    assert turn_repair.repairs(turns_of(spark, [])).collect() == []
