"""Block parsers: the composed automata against one run over the whole file, and fixtures."""

import random

import pytest

from trivium.sources import blocks, checkpoint_folder, files

MD = ["text", "# head", "```", "````", "~~~", "```py", "~~~~ x", "<!-- open", "shut -->", "---", "", "    code", "```a`b"]
YML = ["a: 1", "b: |", "  c: 2", "    d: 3", "", "- e: >-", "f: {g: 1,", "  h: [1, 2]}", "i: {j: {k: 1}}", "'l m': 2", "# n: 3", "x]"]


@pytest.mark.parametrize("automaton,vocabulary", [(blocks.MARKDOWN, MD), (blocks.YAML, YML)])
def test_chunks_compose_to_the_whole(spark, automaton, vocabulary):
    checkpoint_folder(spark)
    r = random.Random(3)
    texts = {f"p{i}": [r.choice(vocabulary) for _ in range(r.randint(0, 40))] for i in range(25)} | {"matter": ["---", "# no", "---", "# yes"]}
    rows = spark.createDataFrame([(p, i, x) for p, t in texts.items() for i, x in enumerate(t)], "path string, line long, content string")
    want = {}
    for p, t in texts.items():
        state = automaton.start
        for i, x in enumerate(t):
            state, want[p, i] = automaton.step(state, x)
    for chunk in (3, 1000):
        assert {(x.path, x.line): x.label for x in blocks.labelled(rows, automaton, chunk).collect()} == want


MARKDOWN = """---
title: x
---
# One

Two words
=========

```sh
# not a heading
[no](code.md)
```
### Three ###
- item
---
Sub
---
<!-- # hidden
# hidden too -->
see [a](a.md#x), [b][Ref  One], [ref one][], [ref two] and [none], `[c](c.md)`, <https://d.example/e>

[ref one]: b.md "title"
[Ref Two]: <c.md>
[ref one]: other.md
"""

YAML = """name: ci
"on": [push]
jobs:
  build:
    steps:
      - run: |
          key: not one
          other: none
      - uses: x  # y: z
    env: {A: 1, "B c": {D: 2}}
    matrix: {os: [a,
      b], v: 3}
last: ''
"""


@pytest.fixture(scope="module")
def marked(spark):
    checkpoint_folder(spark)
    lines = files.lines(spark.createDataFrame([("a.md", MARKDOWN), ("b.yml", YAML)], "path string, text string"))
    return blocks.labelled(lines.filter("path = 'a.md'"), blocks.MARKDOWN, 4).cache(), blocks.labelled(lines.filter("path = 'b.yml'"), blocks.YAML, 4).cache()


def test_headings_outside_of_fences(marked):
    got = sorted((r.line, r.level, r.title, r.slug) for r in blocks.headings(marked[0]).collect())
    assert got == [(3, 1, "One", "one"), (5, 1, "Two words", "two-words"), (12, 3, "Three", "three"), (15, 2, "Sub", "sub")]


def test_links_inline_by_reference_and_alone(marked):
    assert sorted(r.target for r in blocks.links(marked[0]).collect()) == ["a.md#x", "b.md", "b.md", "c.md", "https://d.example/e"]


def test_sections_end_at_the_next_heading_of_their_level(marked):
    got = {r.title: (r.line, r["last"]) for r in blocks.sections(marked[0]).collect()}
    assert got == {"One": (3, 4), "Two words": (5, 24), "Three": (12, 14), "Sub": (15, 24)}


def test_section_digests_tell_changed_sections(spark, marked):
    lines = files.lines(spark.createDataFrame([("a.md", MARKDOWN.replace("- item", "- other"))], "path string, text string"))
    new = {r.title: r.digest for r in blocks.sections(blocks.labelled(lines, blocks.MARKDOWN)).collect()}
    old = {r.title: r.digest for r in blocks.sections(marked[0]).collect()}
    assert {t for t in old if old[t] != new[t]} == {"Two words", "Three"}


def test_keys_in_block_and_flow_form(marked):
    got = [(r.line, r.key) for r in blocks.keys(marked[1]).collect()]
    assert sorted(got) == sorted([(0, "name"), (1, "on"), (2, "jobs"), (3, "build"), (4, "steps"), (5, "run"), (8, "uses"), (9, "env"), (9, "A"), (9, "B c"), (9, "D"), (10, "matrix"), (10, "os"), (11, "v"), (12, "last")])


def test_lines_are_labelled_once_for_headings_and_not_group_by_group(spark):
    checkpoint_folder(spark)
    lines = spark.createDataFrame([("a", i, c) for i, c in enumerate(["# x", "```", "# no", "```", "y", "==="])], "path string, line long, content string")
    found = blocks.headings(blocks.labelled(lines, blocks.MARKDOWN, 2))
    assert sorted((r.line, r.level, r.title) for r in found.collect()) == [(0, 1, "x"), (4, 1, "y")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("InPandas") == 1


def test_lines_are_labelled_twice_for_links_of_all_forms(spark):
    checkpoint_folder(spark)
    content = ["[a](b.md) <http://c> [d][e] [e][] [f](g) [e]", "[e]: h.md", "```", "[no](no.md)", "```"]
    lines = spark.createDataFrame([("a", i, c) for i, c in enumerate(content)], "path string, line long, content string")
    found = blocks.links(blocks.labelled(lines, blocks.MARKDOWN, 2))
    assert sorted((r.line, r.place, r.target) for r in found.collect()) == [(0, 0, "b.md"), (0, 0, "h.md"), (0, 0, "h.md"), (0, 0, "http://c"), (0, 1, "g"), (0, 1, "h.md")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("InPandas") == 2
