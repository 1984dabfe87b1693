"""Digests of subtrees and tree patterns against brute force on random trees."""

import random
from itertools import combinations

import pytest

from trivium.operators import facets, twigs

SCHEMA = "artifact long, node_id long, parent_id long, op string, name string, start long, end long, depth int"


class Node:
    def __init__(self, op, name, kids):
        self.op, self.name, self.kids = op, name, kids


def random_tree(r, depth=4):
    op = r.choice(["apply", "apply", "bind", "ref", "ref", "unit", "opaque"])
    kids = [] if op in ("ref", "opaque") or depth == 0 else [random_tree(r, depth - 1) for _ in range(r.randint(0, 3))]
    return Node(op, r.choice(["a", "b", None] if op == "apply" else ["a", "b", "c"]), kids)


def rows_of(trees):
    """Rows of the trees and the node of each id."""
    rows, nodes = [], {}

    def walk(node, artifact, parent, depth, at):
        i = len(nodes)
        nodes[i] = node
        node.id, node.parent = i, parent
        start = at
        for kid in node.kids:
            at = walk(kid, artifact, node, depth + 1, at)
        end = at
        rows.append((artifact, i, parent.id if parent else None, node.op, node.name, start, end, depth))
        return end + 1

    for artifact, tree in enumerate(trees):
        walk(tree, artifact, None, 0, 0)
    return rows, nodes


def printed(node):
    """A subtree with names that it binds replaced by the distance of their binder."""
    out = []

    def walk(n, depth, scope):
        if n.op == "bind":
            out.append((n.op, depth, "bound"))
            scope = {**scope, n.name: len(out)}
        elif n.op == "ref" and n.name in scope:
            out.append((n.op, depth, "#", len(out) + 1 - scope[n.name]))
        else:
            out.append((n.op, depth, n.name))
        for k in n.kids:
            walk(k, depth + 1, scope)

    walk(node, 0, {})
    return tuple(out)


@pytest.mark.parametrize("seed", [0, 1])
def test_digests_are_equal_where_trees_are(spark, seed):
    r = random.Random(seed)
    rows, nodes = rows_of([random_tree(r) for _ in range(60)])
    got = {x.node_id: x for x in facets.digests(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got.keys() == nodes.keys()
    want = {i: printed(n) for i, n in nodes.items()}
    assert all(got[i].size == len(want[i]) for i in nodes)
    by_digest, by_print = {}, {}
    for i in nodes:
        by_digest.setdefault(got[i].digest, set()).add(i)
        by_print.setdefault(want[i], set()).add(i)
    assert sorted(map(sorted, by_digest.values())) == sorted(map(sorted, by_print.values()))
    some = facets.digests(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(3,), (5,)], "node_id long")).collect()
    assert {x.node_id: x.digest for x in some} == {i: got[i].digest for i in (3, 5)}


def test_digests_of_a_tree_as_deep_as_it_has_nodes(spark):
    """A chain of 200,000 nodes: binders x0, x1 ... and at the end uses of the outermost and of a name from outside."""
    n = 100_000
    chain = lambda artifact, prefix, free: spark.range(n).selectExpr(f"{artifact}L AS artifact", f"{artifact * 10**7}L + id AS node_id", f"CASE WHEN id > 0 THEN {artifact * 10**7}L + id - 1 END AS parent_id", f"CASE WHEN id < {n - 1} THEN 'bind' ELSE 'ref' END AS op", f"CASE WHEN id < {n - 1} THEN concat('{prefix}', id) ELSE '{free}' END AS name", "id AS start", f"{2 * n}L - id AS end", "cast(id AS int) AS depth")
    nodes = chain(1, "x", "x0").unionByName(chain(2, "y", "y0")).unionByName(chain(3, "x", "x1")).unionByName(chain(4, "z", "free"))
    roots = spark.createDataFrame([(a * 10**7 + i,) for a in (1, 2, 3, 4) for i in (0, 1)], "node_id long")
    got = {r.node_id: r for r in facets.digests(nodes, roots).collect()}
    at = lambda a, i: got[a * 10**7 + i].digest
    assert got[10**7].size == n and at(1, 0) == at(2, 0) and at(1, 0) != at(3, 0) and at(1, 0) != at(4, 0)
    assert at(1, 1) != at(2, 1)  # below the binder the names x0 and y0 are free, and differ


def found(node, twig, holes):
    """All ways to match, as dictionaries of holes."""
    if twig.op is not None and node.op != twig.op or twig.name is not None and node.name != twig.name:
        return
    if twig.hole is not None and not twig.many:
        if twig.hole in holes:
            if printed(holes[twig.hole]) != printed(node):
                return
        else:
            holes = {**holes, twig.hole: node}
    deep = [x for x in twig.items if x.deep]

    def below(n):
        for k in n.kids:
            yield k
            yield from below(k)

    def more(holes, rest):
        if not rest:
            yield holes
            return
        for k in below(node):
            for h in found(k, rest[0], holes):
                yield from more(h, rest[1:])

    def placed(items, places, i, holes):
        if i == len(items):
            yield from more(holes, deep)
            return
        if items[i].many:
            yield from placed(items, places, i + 1, {**holes, items[i].hole: places[i]} if items[i].hole else holes)
            return
        for h in found(node.kids[places[i]], items[i], holes):
            yield from placed(items, places, i + 1, h)

    items = twig.children
    if not twig.closed:
        yield from more(holes, deep)
        return
    single = [i for i, x in enumerate(items) if not x.many]
    for chosen in combinations(range(len(node.kids)), len(single)):
        places, ok, last = {}, True, -1
        at = dict(zip(single, chosen))
        for i, x in enumerate(items):
            if x.many:
                nxt = next((at[j] for j in single if j > i), len(node.kids))
                if i + 1 < len(items) and items[i + 1].many:
                    nxt = last + 1
                places[i] = (node.id, last + 2, nxt)
                last = nxt - 1
            else:
                ok = ok and at[i] == last + 1
                places[i] = at[i]
                last = at[i]
        if ok and last == len(node.kids) - 1:
            yield from placed(items, places, 0, holes)


PATTERNS = [
    "apply($A, $B)", "apply", "apply()", 'ref "a"', "apply($A, $$$REST)", "apply($$$X, ref, $$$Y)", "apply($$$, bind($$$C), $D)", "apply($A, $$$, $A)",
    "$F(ref)", "unit(..ref \"b\")", "bind(..$U, $$$K)", "apply($$$, apply($A, $$$), $$$)", "apply($$$P, $A, $$$Q, $B, $$$R)", "$T($A, $A)", "$T:apply($$$, $R:ref \"a\", $$$)",
]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_matches_equal_brute_force(spark, pattern):
    r = random.Random(7)
    rows, nodes = rows_of([random_tree(r) for _ in range(70)])
    twig = twigs.parse(pattern)
    want = []
    for i, n in nodes.items():
        for holes in found(n, twig, {}):
            flat = {"root": i}
            for name, v in holes.items():
                flat |= {f"{name}_of": v[0], f"{name}_from": v[1], f"{name}_to": v[2]} if isinstance(v, tuple) else {name: v.id}
            want.append(tuple(sorted(flat.items())))
    got = [tuple(sorted((k, v) for k, v in x.asDict().items() if k != "artifact")) for x in twigs.match(spark.createDataFrame(rows, SCHEMA), pattern).collect()]
    assert sorted(got) == sorted(want) and want


def test_a_stretch_names_its_nodes(spark):
    tree = Node("apply", None, [Node("ref", x, []) for x in "abcd"])
    rows, _ = rows_of([tree])
    nodes = spark.createDataFrame(rows, SCHEMA)
    got = twigs.stretch(twigs.match(nodes, "apply($A, $$$M, $B)"), nodes, "M").orderBy("ix").collect()
    assert [(x.ix, x.node_id) for x in got] == [(2, tree.kids[1].id), (3, tree.kids[2].id)]


def test_unseen_nodes_leave_matches_unknown(spark):
    trees = [Node("apply", None, [Node("ref", "a", []), Node("ref", "b", [])]), Node("apply", None, [Node("opaque", None, []), Node("ref", "b", [])]), Node("apply", None, [Node("opaque", None, []), Node("ref", "c", [])]), Node("opaque", None, [])]
    rows, _ = rows_of(trees)
    got = {x.node_id: x.truth for x in twigs.matches(spark.createDataFrame(rows, SCHEMA), 'apply(ref "a", ref "b")').collect()}
    assert [got[t.id] for t in trees] == [2, 1, 0, 1]
    assert got[trees[0].kids[0].id] == 0


@pytest.mark.parametrize("text", ["", "apply(", "apply(a b)", "a)", "apply($$$A, $$$A)", "1", "apply($A,,)"])
def test_bad_patterns_are_refused(text):
    with pytest.raises(twigs.PatternError):
        twigs.parse(text)
