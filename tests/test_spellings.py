"""Type spellings against a recursive version, at the cap's boundary and on chains that double."""

import hashlib
import random

from edgewise.operators import spellings

SCHEMA = "node string, ord int, text string, child string, alias boolean"


def varint(n):
    out = b""
    while n >= 128:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def spelt(parts, node, memo):
    """(text, digest) of a node, written out whole."""
    if node not in memo:
        own = sorted((o, t, c, a) for n, o, t, c, a in parts if n == node)
        subs = [None if c is None else spelt(parts, c, memo) for _, _, c, _ in own]
        text = "".join(t if s is None else s[0] for (_, t, _, _), s in zip(own, subs))
        if len(own) == 1 and own[0][3] and subs[0]:
            digest = subs[0][1]
        else:
            digest = hashlib.sha256(b"".join(b"s" + varint(len(t.encode())) + t.encode() if s is None else b"t" + s[1] for (_, t, _, _), s in zip(own, subs))).digest()
        memo[node] = text, digest
    return memo[node]


def shown(text, digest, cap):
    raw = text.encode()
    return text if len(raw) <= cap else raw[:256].decode(errors="ignore") + "…sha256:" + digest.hex()


def test_random_graphs_equal_the_recursive_version(spark):
    rng = random.Random(2)
    parts = []
    for k in range(40):
        below = [f"t{j}" for j in range(max(0, k - 8), k)]
        for o in range(rng.randint(1, 4)):
            child = rng.choice(below) if below and rng.random() < 0.6 else None
            parts.append((f"t{k}", o, None if child else rng.choice(["int", "𝄞é{", "x" * 130, "", "y" * 20_000 if k % 13 == 0 else "; "]), child, False))
    parts += [("alias", 0, None, "t39", True), ("named", 0, None, "t39", False), ("uses", 0, "[]", None, False), ("uses", 1, None, "gone", False)]
    memo = {"gone": ("", hashlib.sha256(b"").digest())}
    want = {n: shown(*spelt(parts, n, memo), 500) for n in {p[0] for p in parts} | {"gone"}}
    got = {r.node: (r.spelling, r.cut) for r in spellings.spellings(spark.createDataFrame(parts, SCHEMA), 500).collect()}
    assert {n: s for n, (s, _) in got.items()} == want and any(c for _, c in got.values()) and not all(c for _, c in got.values())
    assert got["alias"][0] == got["t39"][0] and memo["alias"][1] == memo["t39"][1] != memo["named"][1]


def test_the_cap_is_exact(spark):
    cap = spellings.CAP
    rows = [("whole", 0, "struct{a int \"", None, False), ("whole", 1, "é" * ((cap - 16) // 2), None, False), ("whole", 2, "\"}", None, False)]
    rows += [("over", o, t + ("x" if o == 1 else ""), c, a) for _, o, t, c, a in rows]
    got = {r.node: r for r in spellings.spellings(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not got["whole"].cut and len(got["whole"].spelling.encode()) == cap
    assert got["over"].cut and len(got["over"].spelling.split("…sha256:")[0].encode()) == 256 and len(got["over"].spelling.split("…sha256:")[1]) == 64


def test_chains_that_double_stay_linear_and_cycles_end(spark):
    """Written out the last link would have 2 to the 26 leaves."""
    rows = [("t00", 0, "int", None, False)]
    for k in range(1, 27):
        rows += [(f"t{k:02d}", 0, "struct{a ", None, False), (f"t{k:02d}", 1, None, f"t{k - 1:02d}", False), (f"t{k:02d}", 2, "; b ", None, False), (f"t{k:02d}", 3, None, f"t{k - 1:02d}", False), (f"t{k:02d}", 4, "}", None, False)]
    rows += [("r", 0, "*", None, False), ("r", 1, None, "r", False), ("s", 0, "[]", None, False), ("s", 1, None, "r", False), ("s", 2, None, "t00", False)]
    found = spellings.measured(spark.createDataFrame(rows, SCHEMA)).collect()
    size = {r.node: r.size for r in found}
    assert size["t00"] == 3 and size["t01"] == 20 and size["t26"] == size["r"] == size["s"] == spellings.CAP + 1
    digest, one = {}, {}
    for k in range(27):
        own = [b"int"] if not k else [b"struct{a ", digest[k - 1], b"; b ", digest[k - 1], b"}"]
        digest[k] = hashlib.sha256(b"".join(b"t" + x if len(x) == 32 else b"s" + varint(len(x)) + x for x in own)).digest()
        one[f"t{k:02d}"] = digest[k].hex()
    assert {r.node: r.digest for r in found if r.node[0] == "t"} == one
    assert {r.node: r.digest for r in found}["r"] == hashlib.sha256(b"s\x01*c").hexdigest()
    assert max(len(r.text) for r in found) <= spellings.CAP
