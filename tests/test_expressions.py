"""URL expressions against a queue evaluator, and the budgets."""

import random

from edgewise.operators import expressions

KINDS = "expr string, op string, text string, object string, ref string", "expr string, ord int, child string, text string", "object string, ord int, child string", "object string, closed boolean", "expr string"


def merged(parts):
    out = []
    for p in parts:
        if p == ("lit", ""):
            continue
        if out and out[-1][0] == p[0] == "lit":
            out[-1] = ("lit", out[-1][1] + p[1])
        else:
            out.append(p)
    return out


def evaluate(exprs, operands, values, closed, root):
    """Nodes are met first in, first out; then computed from the last to the first."""
    at = {e: (op, text, obj, ref) for e, op, text, obj, ref in exprs}
    nodes, queue, used = [None], [(0, root)], {}
    kids = lambda table, key: sorted((o, *rest) for k, o, *rest in table if k == key)

    def push(node, child, text, free=False):
        nodes.append(None)
        k = len(nodes) - 1
        if not free and k >= expressions.MOST:
            nodes[k] = ("leaf", [("val", None)])
        elif child is None:
            nodes[k] = ("leaf", [("lit", text or "")])
        else:
            queue.append((k, child))
        return k

    while queue:
        node, e = queue.pop(0)
        op, text, obj, ref = at.get(e, ("val", None, None, None))
        if op == "lit":
            nodes[node] = ("leaf", [("lit", text)])
        elif op == "var":
            held = kids(values, obj)
            if obj in closed or not held or used.get(obj, 0) >= expressions.EACH:
                nodes[node] = ("leaf", [("val", ref)])
            else:
                used[obj] = used.get(obj, 0) + 1
                nodes[node] = ("concat" if len(held) == 1 else "tail", [(o, push(node, c, "")) for o, c in held], ref)
        elif op in ("concat", "format", "trim", "url"):
            nodes[node] = (op, [(o, push(node, c, t, op == "format")) for o, c, t in kids(operands, e)], text)
        else:
            nodes[node] = ("leaf", [("val", ref)])
    done = {}
    for k in range(len(nodes) - 1, -1, -1):
        op, below, *more = nodes[k]
        if op == "leaf":
            done[k] = merged(below)
            continue
        lists = [(o, done[x]) for o, x in below]
        parts = merged([p for _, x in lists for p in x])
        if op == "tail":
            parts = [("tail", None)] if all(not x or (x[0][0] == "lit" and x[0][1].startswith("?")) for _, x in lists) else [("val", more[0])]
        elif op == "trim" and parts and parts[-1][0] == "lit":
            text = parts[-1][1].rstrip("/") if more[0] == "all" else parts[-1][1].removesuffix("/")
            parts = merged([*parts[:-1], ("lit", text)])
        elif op == "url":
            by = dict(lists)
            start = [] if 0 not in by else [("lit", f"{more[0]}://{by[0][0][1]}")] if more[0] not in (None, "", "?") and len(by[0]) == 1 and by[0][0][0] == "lit" else [("origin", None)]
            path = by.get(1, [])
            if 0 in by and path and not (path[0][0] == "lit" and path[0][1].startswith("/")):
                path = [("lit", "/"), *path]
            parts = merged(start + path)
        done[k] = parts
    return done[0]


def check(spark, exprs, operands, values, closed, roots):
    frames = [spark.createDataFrame(x, k) for x, k in zip((exprs, operands, values, [(o, True) for o in closed], [(r,) for r in roots]), KINDS)]
    got = {r.expr: [(p.kind, p.text if p.kind == "lit" else p.ref) for p in r.parts] for r in expressions.evaluated(*frames).collect()}
    assert got == {r: evaluate(exprs, operands, values, closed, r) for r in roots}
    return got


def test_random_expressions_equal_the_queue_evaluator(spark):
    """Operands lie below their expression; only variables lead back up."""
    rng = random.Random(3)
    exprs, operands, values = [], [], []
    for k in range(30):
        op = rng.choice(["lit", "lit", "var", "var", "val", "concat", "concat", "format", "trim", "url", "join"])
        text = {"lit": rng.choice(["/a/", "?q=1", "", "x", "//"]), "trim": rng.choice(["all", "one"]), "url": rng.choice(["https", "?", None])}.get(op)
        exprs.append((f"e{k}", op, text, f"v{rng.randrange(8)}" if op == "var" else None, f"ref{k}" if op in ("var", "val") else None))
        n = {"concat": 2, "format": 3, "trim": 1, "url": 2}.get(op, 0)
        operands += [(f"e{k}", j, *((None, rng.choice(["/", "lit", ""])) if op == "format" and j % 2 else (f"e{rng.randrange(k + 1, 31)}", None))) for j in range(n)]
    for v in range(8):
        values += [(f"v{v}", j, None if rng.random() < 0.2 else f"e{rng.randrange(12, 30)}") for j in range(rng.choice([1, 1, 2]))]
    check(spark, exprs, operands, values, {"v1"}, [f"e{k}" for k in range(30)])


def test_budgets_of_nodes_and_of_a_variable(spark):
    exprs = [(f"c{k}", "concat", None, None, None) for k in range(10)] + [("c10", "lit", "x", None, None)]
    operands = [(f"c{k}", j, f"c{k + 1}", None) for k in range(10) for j in (0, 1)]
    exprs += [("six", "concat", None, None, None), ("use", "var", None, "base", "pkg.Base"), ("https", "lit", "h", None, None)]
    operands += [("six", j, "use", None) for j in range(6)]
    got = check(spark, exprs, operands, [("base", 0, "https")], set(), ["c0", "six", "c5", "nowhere"])
    assert got["six"] == [("lit", "hhhh"), ("val", "pkg.Base"), ("val", "pkg.Base")] and got["c5"] == [("lit", "x" * 32)]
    assert ("val", None) in got["c0"] and got["nowhere"] == [("val", None)]
