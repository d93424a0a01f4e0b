import json
import random

import numpy as np
import pytest

from twinweave import cli, rpc
from twinweave.config import ScanConfig
from twinweave.functions.scalar import mod_m61, one_decimal
from twinweave.operators import incremental, lexer, metrics, pairs, structure
from twinweave.plans import report, view
from twinweave.plans.scan import Cancelled, scan
from twinweave.sources import files, git
from twinweave.sources.languages import Language, language, language_of, languages, register_language

from pyspark.sql import functions as F

SRC = "file_idx bigint, path string, content string"
FN = "fn work(a: u32, b: u32) -> u32 {\n    let mut total = a + b;\n    for i in 0..10 {\n        total += i * a;\n    }\n    if total > 100 { return total; }\n    println!(\"{}\", total);\n    total\n}\n\n"


def table(spark, rows):
    return spark.createDataFrame(rows, SRC)


# --- languages and paths


def test_every_extension_resolves(spark):
    rows = [(i, f"a/b.{e.upper()}", "") for i, (e, _) in enumerate((e, x) for x in languages() for e in x.extensions)]
    names = [x.name for x in languages() for _ in x.extensions]
    got = [r.l for r in table(spark, rows).select("file_idx", language_of("path").alias("l")).orderBy("file_idx").collect()]
    assert got == names and len(languages()) >= 12
    odd = table(spark, [(1, "a.xyz", ""), (2, "noext", ""), (3, ".rs", ""), (4, None, ""), (5, "d.rs/x", ""), (6, "d\\m.py", "")])
    assert [r.l for r in odd.select(language_of("path").alias("l"), "file_idx").orderBy("file_idx").collect()] == [None] * 5 + ["Python"]


def test_register_language(spark):
    register_language(Language("Zed", ("zed",), ("do",)))
    assert table(spark, [(1, "x.zed", "")]).select(language_of("path").alias("l")).first().l == "Zed"
    from twinweave.sources import languages as mod

    mod._languages.pop("Zed")


def test_default_config():
    c = ScanConfig()
    assert (c.min_tokens, c.k, c.w, c.ignore_patterns[0], c.detect_type2) == (50, 25, 30, "node_modules", True)
    assert ScanConfig.from_json(c.to_json(), strict=True) == c
    with pytest.raises(ValueError):
        ScanConfig.from_json('{"directory": "x"}', strict=True)


# --- lexer


def kinds(text, name="Rust"):
    return [lexer.KINDS[k] for k in lexer.lex(text, language(name))[0]]


def test_token_kinds():
    assert kinds("// c\nlet x = 42; /* b */ \"s\"") == ["keyword", "identifier", "punctuation", "number", "punctuation", "string"]
    assert kinds("// only\n/* comments\n */") == [] and kinds("") == []
    assert kinds("'a' \"b\" `c`", "JavaScript") == ["string"] * 3
    assert kinds("0..10") == ["number"] and kinds("1e-5") == ["number", "punctuation", "number"]
    assert kinds('"""doc"""', "Python") == ["string"] * 3
    assert kinds("<!-- x -->a", "HTML") == ["identifier"]
    assert kinds("/* open") == [] and kinds('"open \\') == ["string"]


def test_comment_marks_of_letters():
    basic = Language("Basic", ("bas",), ("LET",), "REM", None)
    assert [lexer.KINDS[k] for k in lexer.lex("LET x REM y z\nw é", basic)[0]] == ["keyword", "identifier", "identifier", "identifier"]


def test_lines_and_offsets():
    kind, tok, a, b, at = lexer.lex("é 'x\ny' z\r\n½ end", language("Rust"))
    assert (a.tolist(), b.tolist(), at.tolist()) == ([1, 1, 2, 3, 3], [1, 2, 2, 3, 3], [0, 3, 9, 12, 15])
    assert tok[3] == 2000 + (0xBD & 255)


def test_long_texts():
    text = '"' + "x" * 300_000 + '"\n/*' + "y\n" * 100_000 + "*/ end"
    _, _, a, b, _ = lexer.lex(text, language("C"))
    assert a.tolist() == [1, 100_002]


# --- hashes


def test_kgram_hashes_are_exact():
    rng = random.Random(2)
    for k in (1, 5, 25, 200):
        codes = np.array([rng.randrange(1 << 48) + 4096 for _ in range(k + 20)], np.int64)
        for h, base in zip(lexer.kgram_hashes(codes, k), lexer.BASES):
            for i in range(len(h)):
                v = 0
                for c in codes[i : i + k].tolist():
                    v = (v * base + c) % lexer.M61
                assert h[i] == v
    assert len(lexer.kgram_hashes(np.arange(3), 5)[0]) == 0


def stepwise(h, w):
    """Winnowing one k-gram at a time, with the special first window."""
    n = len(h)
    if not n:
        return []
    if n < w:
        return [min(range(n), key=lambda i: (h[i], -i))]
    out, at = [], 0
    for i in range(n - w + 1):
        new = i + w - 1
        if at < i:
            at = min(range(i, new + 1), key=lambda j: (h[j], -j))
            out.append(at)
        elif h[new] <= h[at]:
            at = new
            out.append(at)
    return sorted(set(out))


def test_winnow_equals_stepwise():
    rng = random.Random(3)
    for _ in range(3000):
        n, w, top = rng.randrange(0, 30), rng.randrange(1, 9), rng.choice([1, 2, 4, 50])
        h = [(rng.randrange(top), rng.randrange(2)) for _ in range(n)]
        got = lexer.winnow(np.array([x[0] for x in h], np.int64), np.array([x[1] for x in h], np.int64), w)
        assert got.tolist() == stepwise(h, w), (h, w)


def test_winnow_of_equal_tokens():
    h1, h2 = lexer.kgram_hashes(np.ones(20, np.int64), 5)
    assert 0 < len(lexer.winnow(h1, h2, 4)) <= 16


def test_mod_m61(spark):
    m = lexer.M61
    got = spark.createDataFrame([(x,) for x in (0, 100, m, m + 5, 4 * m + 3)], "x bigint").select(mod_m61(F.col("x")).alias("m")).collect()
    assert [r.m for r in got] == [0, 100, 0, 5, 3] and lexer.mod_m61(10 * m + 42) == 42


def test_one_decimal(spark):
    values = [91.85, 93.35, 0.25, 0.75, 0.35, 100.0, 99.95, 0.05, 1 / 3]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(one_decimal(F.col("v")).alias("s")).collect()
    assert [r.s for r in got] == [f"{v:.1f}" for v in values]


# --- scans


def test_two_equal_files_match(spark):
    f = table(spark, [(1, "a.rs", FN * 6), (2, "b.rs", FN * 6)])
    done = scan(spark, f, ScanConfig(scan_self=False))
    m = done.metrics.first()
    assert m.total_clones > 0 and 0 <= m.dry_health_score <= 100
    assert all(p.file_a != p.file_b for p in done.pairs.collect())


def test_no_overlap_within_a_file(spark):
    f = table(spark, [(1, "s.rs", "let value = compute(a, b, c);\n\n" * 60)])
    for p in scan(spark, f, ScanConfig(min_tokens=20)).pairs.collect():
        assert p.end_line_a < p.start_line_b or p.end_line_b < p.start_line_a


def test_filters_and_empty(spark):
    f = table(spark, [(1, "t.rs", "fn a() {}"), (2, "t.py", "x = 1"), (3, "node_modules/q.rs", ""), (4, "n.rs", None), (5, "x.bin", "a")])
    r = scan(spark, f, ScanConfig(languages=("Rust",))).result().first()
    assert r.total_files == 2 and [x.language for x in r.language_breakdown] == ["Rust"]
    e = scan(spark, table(spark, []), ScanConfig()).result().first()
    assert (e.total_files, e.total_tokens, e.total_clones, e.duplication_percentage, e.dry_health_score) == (0, 0, 0, 0.0, 100.0)


def test_progress_and_cancel(spark):
    said = []
    scan(spark, table(spark, []), progress=lambda *a: said.append(a[0]))
    assert said == ["Discovery", "Tokenization", "Indexing", "Merging", "Complete"]
    with pytest.raises(Cancelled, match="Scan cancelled"):
        scan(spark, table(spark, []), cancelled=lambda: True)


def test_result_does_not_depend_on_partitions(spark):
    f = table(spark, [(i, f"m{i}/a.rs", FN * (1 + i % 3)) for i in range(8)])
    c = ScanConfig(min_tokens=30)
    a = scan(spark, f.repartition(1), c).pairs.collect()
    b = scan(spark, f.repartition(7), c).pairs.collect()
    assert sorted(a) == sorted(b) and a


def test_renamed_names_match_only_when_normalised(spark):
    f = table(spark, [(1, "a.rs", FN * 3), (2, "b.rs", FN.replace("total", "sum").replace("work", "play") * 3)])
    found = lambda t2: scan(spark, f, ScanConfig(scan_self=False, detect_type2=t2)).pairs.count()
    assert found(True) > 0 and found(False) == 0


def test_extra_and_clashing_columns(spark):
    f = table(spark, [(1, "a.rs", FN * 6), (2, "b.rs", FN * 6)]).selectExpr("*", "1 AS pos", "'x' AS h1", "'y' AS language", "2 AS token_count")
    assert scan(spark, f, ScanConfig(scan_self=False)).pairs.count() > 0


def test_fold_against_loop(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(300):
        sa, sb = rng.randrange(1, 60), rng.randrange(1, 60)
        rows.append((rng.choice([1, 2]), sa, sa + rng.randrange(6), 2, sb, sb + rng.randrange(6), rng.randrange(9), 0))
    df = spark.createDataFrame(rows, "file_a bigint, start_a int, end_a int, file_b bigint, start_b int, end_b int, h1 bigint, h2 bigint")
    want = []
    for key in (1, 2):
        cur = None
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[4], r[2], r[5], r[6], r[7])):
            if cur and r[1] <= cur[2] + 3 and r[4] <= cur[5] + 3:
                ea, eb = max(cur[2], r[2]), max(cur[5], r[5])
                overlap = cur[0] == cur[3] and (ea >= cur[4] if cur[1] <= cur[4] else eb >= cur[1])
                if not overlap:
                    cur = (*cur[:2], ea, *cur[3:5], eb, *cur[6:])
                    continue
            if cur:
                want.append(cur)
            cur = r
        want.append(cur)
    got = pairs.merged_pairs(df).drop("n_raw").select(*pairs.RAW).collect()
    assert sorted(map(tuple, got)) == sorted(want)


# --- figures, view, reports


def test_duplication_clamps(spark):
    p = spark.createDataFrame([("a/x", "b/y", 70), ("a/x", "a/z", None)], "file_a string, file_b string, token_count bigint")
    total = lambda n: spark.createDataFrame([(n,)], "total_tokens bigint")
    m = metrics.duplication(p, total(10)).first()
    assert (m.duplication_percentage, m.cross_module_ratio, m.dry_health_score) == (100.0, 0.5, 0.0)
    assert metrics.duplication(p.limit(0), total(None)).first().dry_health_score == 100.0


PAIR = "file_a string, start_line_a int, end_line_a int, file_b string, start_line_b int, end_line_b int, token_count bigint, similarity double, fragment_hash string"


def test_view(spark):
    p = spark.createDataFrame([("src/A.ts", 1, 2, "x.json", 1, 2, 9, 0.95, "a"), ("b.rs", 1, 2, None, 3, 4, None, 0.5, None), ("c.xyz", 5, 6, "d.js", 1, 9, 7, 1.0, "c")], PAIR)
    assert view.view_clone_pairs(p, search=" a.TS ").count() == 1 and view.view_clone_pairs(p, min_similarity=95).count() == 2
    assert view.view_clone_pairs(p, language="JavaScript").count() == 2 and view.view_clone_pairs(p, language="Cobol").count() == 0
    assert [r.token_count for r in view.sorted_page(p, "tokens").collect()] == [9, 7, None]
    assert view.sorted_page(p, "filename", 2, 2).first().row == 3 and view.page_count(p.limit(0)).first().n_pages == 1
    assert view.clamp_page(1, -1, 5) == 1 and view.clamp_page(5, 1, 5) == 5
    a, b = view.path_parts("file_a")
    assert p.select(a.alias("a"), b.alias("b")).first()[:2] == ("src/", "A.ts")


def test_reports(spark, tmp_path, capsys):
    for n in ("a.rs", "b.rs", ".hidden.rs"):
        (tmp_path / n).write_text(FN * 6)
    (tmp_path / "bad.rs").write_bytes(b"\xff\xfe")
    assert files.read_directory(spark, str(tmp_path)).where("content IS NOT NULL").count() == 2
    assert cli.main([str(tmp_path), "--fail-threshold", "1", "--languages", "Rust,Python"], spark) == 1
    assert "Clone pairs:" in capsys.readouterr().out
    cli.main([str(tmp_path), "--format", "json", "-o", str(tmp_path / "r.json")], spark)
    assert json.loads((tmp_path / "r.json").read_text())["total_files"] == 3
    done = scan(spark, files.read_directory(spark, str(tmp_path)))
    assert report.markdown(done).count("\n| `") == done.pairs.count() and "<table>" in report.html_report(done)
    assert cli.main(["/nonexistent", "--format", "markdown"], spark) == 0


def test_ignore_files(spark, tmp_path):
    for n in ("a.rs", "b.log", "keep.log", "out/x.rs", "deep/out/y.rs", "deep/only/z.rs", "deep/w.rs", "gen/q1.rs", "with space.rs"):
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text("x")
    (tmp_path / ".gitignore").write_text("# c\n*.log\n!keep.log\n/out/\ngen/q?.rs\n")
    (tmp_path / "deep" / ".gitignore").write_text("only\n")
    got = {r.path for r in files.read_directory(spark, str(tmp_path)).collect()}
    assert got == {"a.rs", "keep.log", "deep/out/y.rs", "deep/w.rs", "with space.rs"}


def test_rpc():
    run = lambda c: f"{c.directory} {c.min_tokens}"
    assert rpc.answer("nonsense", run)["error"]["code"] == -32700
    assert rpc.answer('{"id": 1, "method": "x"}', run)["error"]["code"] == -32601
    call = {"id": 2, "method": "tools/call", "params": {"name": "scan_codebase", "arguments": {"min_tokens": "7"}}}
    assert rpc.answer(json.dumps(call), run)["result"]["content"][0]["text"] == ". 50"
    assert rpc.answer(json.dumps(call), lambda c: 1 / 0)["error"]["code"] == -32603
    assert rpc.answer('{"id": 3, "method": "tools/list"}', run)["result"]["tools"][0]["name"] == "scan_codebase"


def test_http():
    import threading
    import urllib.request

    from twinweave import serve

    run = lambda c: json.dumps({"got": c.directory})
    assert serve.respond("POST", "/api/scan", b"{}", run)[0] == 422 and serve.respond("GET", "/x", b"", run)[0] == 404
    assert serve.respond("POST", "/api/scan", ScanConfig().to_json().encode(), lambda c: 1 / 0)[0] == 500
    s = serve.server(0, run)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{s.server_port}"
    assert json.load(urllib.request.urlopen(f"{url}/api/health"))["status"] == "ok"
    request = urllib.request.Request(f"{url}/api/scan", ScanConfig("here").to_json().encode())
    assert json.load(urllib.request.urlopen(request)) == {"got": "here"}
    s.shutdown()


# --- rescans, structure, git, streams


def test_incremental(spark):
    f = table(spark, [(1, "a.rs", "1"), (2, "b.rs", "2"), (3, "c.rs", None)])
    old = incremental.manifest(table(spark, [(1, "a.rs", "1"), (2, "b.rs", "x"), (9, "z.rs", "9")]))
    assert {(r.path, r.change) for r in incremental.changes(old, incremental.manifest(f)).collect()} == {("a.rs", "unchanged"), ("b.rs", "modified"), ("z.rs", "deleted")}
    assert {r.path for r in incremental.changed_files(f, old).collect()} == {"b.rs", "c.rs"}
    kept = spark.createDataFrame([(1, "old"), (2, "old"), (9, "old")], "file_idx bigint, v string")
    new = incremental.refreshed(kept, f, old, lambda c: c.select("file_idx", F.lit("new").alias("v")))
    assert {tuple(r) for r in new.collect()} == {(1, "old"), (2, "new"), (3, "new")}
    assert len(incremental.manifest(f).first().sha256) == 64


def test_subtrees(spark):
    a, b = "def f(x):\n    if x:\n        return 1\n", "def g(y):\n    if y:\n        return 2\n"
    ha, hb = structure.subtree_hashes(a, "Python"), structure.subtree_hashes(b, "Python")
    assert ha and [x[0] for x in ha] == [x[0] for x in hb] and ha[-1][4] == "Module"
    assert structure.subtree_hashes("def (", "Python") == [] and structure.subtree_hashes("<p><b>x</b></p>", "HTML")
    assert structure.subtree_hashes("(" * 5000, "C")
    f = table(spark, [(1, "a.py", a), (2, "b.py", b), (3, "c.py", ""), (4, "d.rs", FN)])
    assert structure.structural_clones(structure.ast_hashes(f)).where("n_files = 2").count() > 0


def test_git_authors(spark, tmp_path):
    import subprocess

    env = {"GIT_AUTHOR_NAME": "Ann", "GIT_AUTHOR_EMAIL": "a@x", "GIT_COMMITTER_NAME": "Ann", "GIT_COMMITTER_EMAIL": "a@x", "HOME": str(tmp_path), "PATH": "/usr/bin:/bin"}
    (tmp_path / "a.rs").write_text("one\ntwo\n")
    for c in (["init", "-q"], ["add", "."], ["commit", "-qm", "x"]):
        subprocess.run(["git", "-C", str(tmp_path), *c], check=True, env=env)
    p = spark.createDataFrame([("a.rs", 2, 2, "none.rs", 1, 1, 5, 1.0, "h")], PAIR)
    authors = git.line_authors(spark, str(tmp_path), spark.createDataFrame([("a.rs",), ("none.rs",)], "path string"))
    r = git.with_authors(p, authors).first()
    assert r.author_a.startswith("Ann (line 2, ") and r.author_b is None
    assert git.blame("/tmp", "nothing.rs") == []


def test_watch(spark, tmp_path):
    from twinweave.streaming.watch import rescan_changed, watch

    d, out = tmp_path / "in", tmp_path / "out"
    d.mkdir()
    (d / "a.rs").write_text("1")

    def step():
        q = watch(spark, str(d)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(out)).trigger(availableNow=True).start()
        q.awaitTermination(60)
        return sorted((r.path, r.change) for r in spark.read.parquet(str(out)).collect())

    assert step() == [("a.rs", "created")]
    (d / "a.rs").write_text("22")
    (d / "b.rs").write_text("3")
    assert step() == [("a.rs", "created"), ("a.rs", "modified"), ("b.rs", "created")]
    seen = []
    handle = rescan_changed(str(tmp_path / "state"), lambda df: seen.append(sorted(r.path for r in df.collect())))
    batch = lambda *rows: spark.createDataFrame(rows, "path string, content string")
    handle(batch(("a", "1"), ("b", "1")), 0)
    handle(batch(("a", "1"), ("b", "2")), 1)
    handle(batch(("b", "2")), 2)
    assert seen == [["a", "b"], ["b"], []]


def test_classes_and_links_against_all_pairs(spark):
    import random
    from collections import Counter

    rng = random.Random(3)
    rows = []
    for f in range(30):
        line = 1
        for p in range(rng.randrange(0, 25)):
            end = line + rng.randrange(0, 3)
            rows.append((f * 10, p, rng.choice([1, 1, 1, rng.randrange(9)]), 0, line, end))
            line += rng.randrange(0, 3)
    rows += [(None, 0, 1, 0, 1, 1), (5, 0, None, 1, 1, 1)]
    fp = spark.createDataFrame(rows, "file_idx bigint, pos int, h1 bigint, h2 bigint, line_start int, line_end int")
    known = fp.where("file_idx IS NOT NULL")
    raw = pairs.raw_pairs(known).collect()
    by_hash, by_file = Counter((r.h1, r.h2) for r in raw), Counter(x for r in raw for x in {r.file_a, r.file_b})
    classes = {(r.h1, r.h2): r.n_links for r in pairs.clone_classes(known).collect()}
    assert {k: v for k, v in classes.items() if v} == dict(by_hash)
    assert {r.file_idx: r.n_links for r in pairs.file_links(fp).collect() if r.n_links} == dict(by_file)
    # a search with some files gives their share of all pairs, each once
    names = ["file_a", "pos_a", "file_b", "pos_b", "h1", "h2"]
    for scan_self in (True, False):
        want = sorted(tuple(r[c] for c in names) for r in pairs.raw_pairs(known, scan_self).collect() if r.file_a % 50 == 0 or r.file_b % 50 == 0)
        assert sorted(map(tuple, pairs.raw_pairs_of(fp, 50, scan_self).select(*names).collect())) == want and want
    empty = fp.where("false")
    assert pairs.clone_classes(empty).count() == 0 and pairs.file_links(empty).count() == 0 and pairs.raw_pairs_of(empty, 50).count() == 0


def test_directory_listing(spark, tmp_path):
    (tmp_path / "pkg" / "out").mkdir(parents=True)
    for name, text in {"pkg/__init__.py": b"x = 1", "pkg/a.py": b"y", "pkg/bad.py": b"\xff", "pkg/out/b.py": b"z", "pkg/out/keep.py": b"k", ".gitignore": b"# no\npkg/out/*\n!keep.py\n", ".hidden": b"h"}.items():
        (tmp_path / name).write_bytes(text)
    (tmp_path / "loop").symlink_to(tmp_path)
    rows = files.read_directory(spark, str(tmp_path)).orderBy("file_idx").collect()
    assert [(r.file_idx, r.path, r.content) for r in rows] == [(0, "pkg/__init__.py", "x = 1"), (1, "pkg/a.py", "y"), (2, "pkg/bad.py", None), (3, "pkg/out/keep.py", "k")]
    assert [r.path for r in files.read_directory(spark, f"file://{tmp_path}").orderBy("file_idx").collect()] == [r.path for r in rows]
    assert files.read_directory(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception):
        files.read_directory(spark, "nosuchscheme://x/y")


def test_unknown_language_keeps_nothing(spark, tmp_path, capsys):
    (tmp_path / "a.rs").write_text("fn a() {}")
    assert cli.main([str(tmp_path), "--languages", "Cobol"], spark) == 0
    assert "Total files:      0" in capsys.readouterr().out


def test_run_reports_and_keeps(spark):
    import time

    from twinweave.plans.scan import Cancelled, run

    f = spark.createDataFrame([(i, f"m{i}/a.rs", "fn f(a: u8) -> u8 { let b = a + 1; if b > 2 { g(b) } else { h(a, b) } }\n" * 9) for i in range(3)], "file_idx bigint, path string, content string")
    said = []
    began = time.time()
    done = run(scan(spark, f), lambda name, share, text: said.append((name, share)))
    r = done.result().first()
    assert 0 < r.duration_ms <= (time.time() - began) * 1000 + 50 and r.duration_ms > 200
    assert [s[0] for s in said] == ["Discovery", "Tokenization", "Indexing", "Merging", "Complete"] and r.total_clones == done.pairs.count() > 0
    assert "MapInArrow" not in done.pairs._jdf.queryExecution().executedPlan().toString()  # nothing is lexed again
    assert sorted(map(str, done.pairs.collect())) == sorted(map(str, scan(spark, f).pairs.collect()))
    polls = []
    with pytest.raises(Cancelled):
        run(scan(spark, f), cancelled=lambda: polls.append(1) or len(polls) > 3)
    assert spark.range(3).count() == 3  # later jobs are not in the cancelled group


def test_hashes_without_trees_equal_those_of_trees():
    import random

    rng = random.Random(8)
    for name, pieces in (("Rust", ["fn", "a", "(", ")", "{", "}", "[", "]", "1", '"s"', "// c\n", "\n", ";"]), ("Python", ["x = (1,\n 2)\n", "def f(a, b=1):\n    return [a]\n", "class A:\n    'd'\n", "if x:\n    y()\n", "\n", "z = 'é'\n", ")"])):
        for _ in range(150):
            text = "".join(rng.choice(pieces) + rng.choice(["", " "] if name == "Rust" else [""]) for _ in range(rng.randrange(25)))
            # all depths come from the tree, depths from 2 on are hashed as they close
            want = [r for r in structure.subtree_hashes(text, name, 1) if r[5] > 1]
            assert structure.subtree_hashes(text, name, 2) == want, text
            assert structure.subtree_hashes(text, name, 3) == [r for r in want if r[5] > 2]
    # deeper than the interpreter recurses
    deep = structure.subtree_hashes("x = " + "1+" * 3000 + "1", "Python")
    assert max(r[5] for r in deep) > 3000 and deep[-1][4] == "Module"
