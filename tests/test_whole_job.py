"""The queries do their whole job on small tables made for it."""

import subprocess

import __spark_entry__ as entry
from twinweave.config import ScanConfig
from twinweave.llm.parse.check import check_source
from twinweave.operators import structure
from twinweave.plans import catalog
from twinweave.plans.scan import scan
from twinweave.sources.files import read_directory

FN = "fn work(a: u32, b: u32) -> u32 {\n    let mut total = a + b;\n    for i in 0..10 {\n        total += i * a;\n    }\n    if total > 100 { return total; }\n    println!(\"{}\", total);\n    total\n}\n\n"


def test_renamed_copies_are_found_by_the_flagship(spark, tmp_path):
    text = FN * 3
    renamed = text.replace("total", "sum").replace("work", "other").replace("100", "7")
    spark.createDataFrame([(1, "a/x.rs", text), (2, "b/y.rs", renamed)], "file_idx bigint, path string, content string").write.parquet(f"{tmp_path}/source_files.parquet")
    across = lambda name: entry.queries()[name](spark, str(tmp_path)).where("file_a <> file_b").count()
    assert catalog.FLAGSHIP == "clone_pairs_normalised"
    assert across("clone_pairs") == 0 and across(catalog.FLAGSHIP) > 0
    one = lambda name: entry.queries()[name](spark, str(tmp_path)).first()
    assert one("scan_result_normalised").total_clones > one("scan_result").total_clones
    members = entry.queries()["fragment_members_normalised"](spark, str(tmp_path)).collect()
    assert {m.file_idx for m in members} == {1, 2} and all(m.n_places > 1 for m in members)


def test_shared_tokens_are_counted(spark, tmp_path):
    shared = [f"a{i} = b + c + d + e" for i in range(8)]
    own = [f"x{i}" for i in range(8)]
    text = "\n".join(own + shared)
    spark.createDataFrame([(1, "a.py", text), (2, "b.py", "\n".join(shared)), (3, "c.odd", text)], "file_idx bigint, path string, content string").write.parquet(f"{tmp_path}/source_files.parquet")
    prints = [(1, i, 100 + i, 0, i + 1, i + 1) for i in range(8)] + [(1, 8 + i, i, 0, 9 + i, 9 + i) for i in range(8)] + [(f, i, i, 0, i + 1, i + 1) for f in (2, 3) for i in range(8)]
    spark.createDataFrame(prints, "file_idx bigint, pos int, h1 bigint, h2 bigint, line_start int, line_end int").write.parquet(f"{tmp_path}/fingerprints.parquet")
    rows = {r.file_idx: r for r in entry.queries()["p1_share_counted"](spark, str(tmp_path)).collect()}
    assert (rows[1].share, rows[1].token_count, rows[1].shared_tokens) == (0.5, 80, 72)
    assert (rows[2].share, rows[2].token_share) == (1.0, 1.0)
    assert rows[3].share == 1.0 and rows[3].shared_tokens is None


def test_expressions_inside_templates_and_markup_are_parsed():
    bad = [("a.tsx", "x = <p>{a b}</p>;"), ("a.jsx", "x = <p a={}/>;"), ("a.js", "x = `${a b}`;"), ("a.js", "x = `${`${a b}`}`;"), ("a.ts", "x = `${a) + (b}`;"), ("a.ts", "x = `${}`;")]
    good = [
        ("a.tsx", "x = <p a={1} {...r} s={{a: 1}}>{/* c */}{a && <b>{`x${f(y => y + 1)}`}</b>} don't {l.map((i) => { return <i key={i}>{i}</i>; })}</p>;"),
        ("a.ts", "type F<T> = T extends `${infer A}.${string}` ? A : never;\nconst s = `${a // c\n} ${await g(x as T)} ${{a: 1}.a}`;"),
        ("a.js", "s = t`a${`b${c}`}` + `\\${a b}`;"),
    ]
    assert not any(check_source(*x).valid for x in bad)
    assert all(check_source(*x).valid for x in good)
    assert check_source("a.js", "\nx = `\n${a\n b}`;\n").line == 4


def test_indented_sass_is_parsed():
    good = """// a comment
   that goes on
@use "sass:math"
$w: 10px
=round($r: 4px)
  border-radius: $r
.a,
.b
  +round(2px)
  color: red
  &:hover
    font:
      family: "x"
      size: math.div($w, 2)
  > li + li
    @extend %p
  @media (min-width: $w)
    width: calc(100% - #{$w})
/* loud
   more
.alone
@each $k, $v in (a: b)
  .t-#{$k}
    top: $v
@if $w == 1
  p
    top: 0
@else
  p
    top: 1
"""
    assert check_source("a.sass", good) == (True, None, None)
    for bad, line in [("<<<<<<< HEAD\n.a\n  top: 1\n=======\n.a\n  top: 2\n>>>>>>> x\n", 1), (".a\n  color:\n", 2), (".a\n    top: 1\n  left: 2\n", 3), ("  .a\n", 1), ("int main() ; return 0 ;\n", 1), (".a\n  top: (1\n", 2)]:
        v = check_source("a.sass", bad)
        assert (v.valid, v.line) == (False, line), (bad, v)


def test_broken_python_has_subtrees():
    good = "def f(x):\n    if x:\n        return [1, (x, 2)]\n"
    whole = {h for h, *_, kind, _ in structure.subtree_hashes(good, "Python") if kind != "Module"}
    for text, line in [(good + "def (\n", 1), ("x = = 1\n" + good, 2), ("class A:\n    y = (1, 2))\n" + "".join(f"    {x}\n" for x in good.splitlines()), 3)]:
        got = structure.subtree_hashes(text, "Python")
        assert whole <= {r[0] for r in got}
        f = next(r for r in got if r[4] == "FunctionDef")
        assert (f[1], f[2], text.encode()[f[3] :].startswith(b"def f")) == (line, line + 2, True)
    assert structure.subtree_hashes("x = " + "(" * 500 + ")" * 500, "Python")
    assert structure.subtree_hashes("x = " + "1 + " * 5000 + "f(a, (b))", "Python")
    assert any(r[4] == "(" and r[1] == 2 for r in structure.subtree_hashes("y = 1\nx = f((1, 2)) = = \n", "Python"))


def test_scan_names_git_authors(spark, tmp_path):
    env = {"GIT_AUTHOR_NAME": "Ann", "GIT_AUTHOR_EMAIL": "a@x", "GIT_COMMITTER_NAME": "Ann", "GIT_COMMITTER_EMAIL": "a@x", "HOME": str(tmp_path), "PATH": "/usr/bin:/bin"}
    (tmp_path / "x.rs").write_text(FN * 3)
    for c in (["init", "-q"], ["add", "."], ["commit", "-qm", "x"]):
        subprocess.run(["git", "-C", str(tmp_path), *c], check=True, env=env)
    (tmp_path / "y.rs").write_text(FN * 3)
    files = read_directory(spark, str(tmp_path))
    blamed = scan(spark, files, ScanConfig(str(tmp_path), enable_git_blame=True))
    plain = scan(spark, files, ScanConfig(str(tmp_path)))
    rows = blamed.pairs.collect()
    assert blamed.pairs.columns == plain.pairs.columns and len(rows) == plain.pairs.count() > 0
    for r in rows:
        for path, line, author in [(r.file_a, r.start_line_a, r.author_a), (r.file_b, r.start_line_b, r.author_b)]:
            assert author.startswith(f"Ann (line {line}, ") if path == "x.rs" else author is None
    assert all(r.author_a is None and r.author_b is None for r in plain.pairs.collect())
