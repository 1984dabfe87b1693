"""Ignore files against the tool whose rules they follow, on random trees."""

import random
import shutil
import subprocess

import pytest

from trivium.sources import files, ignore

LINES = ["*.log", "!keep.log", "/build", "build/", "docs/*.md", "!docs/x.md", "**/tmp", "tmp/**", "a/**/z.txt", "[ab]?.rs", "[!a]x.rs", "\\#odd", "\\!bang", "# remark", "", "z.txt ", "sp\\ ", "*/y", "!*/", "a", "!a/b", "/*.txt", "!z.txt", "b/", "**", "*.md/"]
NAMES = ["a", "b", "build", "docs", "tmp", "x.md", "z.txt", "keep.log", "q.log", "ax.rs", "bx.rs", "y", "#odd", "!bang"]


def tree(r, folder, depth=0):
    out = []
    for name in r.sample(NAMES, r.randint(2, 6)):
        if depth < 3 and r.random() < 0.45:
            inner = folder / name
            inner.mkdir()
            out += [f"{name}/{x}" for x in tree(r, inner, depth + 1)]
        else:
            (folder / name).write_text("text")
            out.append(name)
    if depth == 0 or r.random() < 0.4:
        (folder / ".gitignore").write_text("\n".join(r.sample(LINES, r.randint(1, 5))))
    return out


@pytest.mark.skipif(shutil.which("git") is None, reason="no git")
def test_ignored_files_are_those_that_git_ignores(spark, tmp_path):
    seen = set()
    for seed in range(12):
        r = random.Random(seed)
        root = tmp_path / f"t{seed}"
        root.mkdir()
        paths = tree(r, root)
        subprocess.run(["git", "init", "-q", str(root)], check=True)
        said = subprocess.run(["git", "-c", "core.excludesFile=", "-C", str(root), "check-ignore", "--no-index", "-z", "--stdin"], input="\0".join(paths).encode(), capture_output=True).stdout
        want = {p for p in said.decode().split("\0") if p}
        texts = [(str(f.parent.relative_to(root)).removeprefix("."), f.read_text()) for f in root.rglob(".gitignore")]
        rows = ignore.ignored(spark.createDataFrame([(p,) for p in paths], "path string"), ignore.rules(spark.createDataFrame(texts, "folder string, text string")))
        assert {x.path for x in rows.collect()} == want, (texts, sorted(paths))
        seen |= want
    assert seen


def test_a_walk_reads_what_is_neither_ignored_nor_large(spark, tmp_path):
    root = tmp_path / "tree"
    for name, content in {"a.md": b"# A", "big.txt": b"x" * 2000, "out/b.md": b"no", "src/c.log": b"no", "src/keep.log": b"yes", "src/d{1}.py": b"\xff\xfe", "src/.gitignore": b"*.log\n!keep.log\n", ".gitignore": b"/out/\n"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    found, large = files.walk(spark, str(root), cap=1000)
    assert {(r.path, r.text) for r in found.collect()} == {("a.md", "# A"), ("src/keep.log", "yes"), ("src/d{1}.py", None)}
    assert [tuple(r) for r in large.collect()] == [("big.txt", 2000)]
    found, _ = files.walk(spark, str(root), cap=1000, ignore_name=None)
    assert {r.path for r in found.collect()} >= {"out/b.md", "src/c.log"}
